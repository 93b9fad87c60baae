"""Controlled vocabularies and patterns. All values here are fixed: results depend on them to the letter."""

TYPE_LABELS = {
    "ACTA_CONSEJO_ACADEMICO": "Acta del Consejo Académico",
    "ACTA_CONSEJO_SUPERIOR": "Acta del Consejo Superior",
    "ACUERDO_ACADEMICO": "Acuerdo Académico",
    "ACUERDO_CESU": "Acuerdo CESU",
    "ACUERDO_SUPERIOR": "Acuerdo Superior",
    "CONPES": "Documento CONPES",
    "Contenido_Programatico": "Contenido Programático",
    "DECRETO_MEN": "Decreto del MEN",
    "DECRETO_NACIONAL": "Decreto Nacional",
    "LEY": "Ley",
    "MALLA_CURRICULAR": "Malla Curricular",
    "Malla_curricular": "Malla Curricular",
    "ORDENANZA_ASAMBLEA_DEL_DEPARTAMENTO_DEL_META": "Ordenanza de la Asamblea del Meta",
    "Plan": "Plan",
    "PLAN_DE_ESTUDIOS_DEL_PROGRAMA": "Plan de Estudios del Programa",
    "Plan_de_estudios_del_programa": "Plan de Estudios del Programa",
    "RESOLUCION_ACADEMICA": "Resolución Académica",
    "RESOLUCION_CONSEJO_DE_FACULTAD_-_FCBI": "Resolución del Consejo de Facultad (FCBI)",
    "RESOLUCION_MEN": "Resolución del MEN",
    "RESOLUCION_MINISTERIO_DE_AMBIENTE_NACIONAL": "Resolución del Ministerio de Ambiente",
    "RESOLUCION_MINISTERIO_DE_EDUCACION_NACIONAL": "Resolución del Ministerio de Educación Nacional",
    "Resolucion_Ministerio_de_Educacion_Nacional": "Resolución del Ministerio de Educación Nacional",
    "RESOLUCION_RECTORAL": "Resolución Rectoral",
    "RESOLUCION_SUPERIOR": "Resolución Superior",
}
SKIP_TYPES = ["MALLA_CURRICULAR", "Malla_curricular", "PLAN_DE_ESTUDIOS_DEL_PROGRAMA", "Plan_de_estudios_del_programa", "Contenido_Programatico", "Plan"]
NATIONAL_HINTS = ["NACIONAL", "MINISTERIO", "_MEN", "CONPES", "LEY", "ORDENANZA", "CESU"]
MASCULINE = ["acuerdo", "decreto", "acta", "documento", "reglamento", "plan"]
ORDINAL_WORDS = ["primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "septimo", "octavo", "noveno", "décimo", "decimo", "único", "unico"]
ADMISSIONS = [
    "no tengo", "no dispongo", "no cuento con", "no encuentro", "no aparece", "no está en", "no se encuentra", "no hay información",
    "no tengo información", "no tengo certeza", "no forma parte", "no puedo", "no está disponible", "no corresponde", "fuera de mi", "no dispongo de",
]
FLAT_PARTS = ["si", "normatividad"]
SHORT_SUFFIX = " de Unillanos"
LONG_SUFFIX = " de la Universidad de los Llanos (Unillanos)"
SYSTEM_PROMPT = (
    "Eres un asistente especializado en normativa universitaria de la Universidad de los Llanos (Unillanos), Colombia. "
    "Responde preguntas sobre reglamentos, resoluciones, acuerdos y documentos normativos. "
    "Responde siempre en español, de manera clara y útil para estudiantes, docentes y administrativos. "
    "Si no tienes certeza sobre una información, indícalo claramente."
)
TRAINING_PROMPT = "Eres un asistente especializado en normativa universitaria de la Universidad de los Llanos (Unillanos), Colombia."
NO_MODEL = "El modelo aún no está disponible.\n\nConfigura la ruta del checkpoint en `config/config.yaml` bajo `model.checkpoint_path`."
LOG_COLUMNS = [
    "fecha", "checkpoint", "n_prueba", "epochs", "learning_rate", "rank", "lora_alpha", "lora_dropout", "bertscore_f1", "coseno_sem",
    "rouge_l", "bleu", "cider", "perdida", "perplejidad", "entropia", "info_mutua", "exactitud_citas", "tasa_alucinacion",
]

# Patterns, in the syntax that Python, Java and RE2 share; flags are added where they're used.
ORDINAL = "(?:[IVXLC]+|\\d+|PRIMER[OA]?|SEGUND[OA]|TERCER[OA]?|CUART[OA]|QUINT[OA]|SEXT[OA]|S[EÉ]PTIM[OA]|OCTAV[OA]|NOVEN[OA]|D[EÉ]CIM[OA])"
SECTION = r"^(CONSIDERANDO|RESUELVE|R\s*E\s*S\s*U\s*E\s*L\s*V\s*E|ACUERDA|DECRETA|RESOLVIÓ|RESOLVIO|DISPONE|ORDENA|CERTIFICA|HACE\s+CONSTAR|EN\s+MÉRITO\s+DE\s+LO\s+EXPUESTO)\s*:?\s*$"
CHAPTER = rf"^(CAP[IÍ]TULO|T[IÍ]TULO)\s+({ORDINAL})\b\s*[.:\-–)]*\s*(.*)$"
ARTICLE = r"^(ART[IÍ]CULO|ART\.)\s+([A-Za-zÁÉÍÓÚÑ0-9°º]+)\s*[.:\-–)]*\s*(.*)$"
PARAGRAPH = r"^(PAR[AÁ]GRAFO)(\s+[A-Za-zÁÉÍÓÚÑ0-9°º]+)?\s*[.:\-–)]*\s*(.*)$"
PAGE_NOISE = r"^P[áa]g(?:ina|\.)?\s*\d+\s*(?:de\s*\d+)?$"
BANNER = r"^UNIVERSIDAD\s+DE\s+LOS\s+LLANOS\b.*(RESOLUCI[ÓO]N|ACUERDO|DECRETO|CONSEJO)|^(RESOLUCI[ÓO]N|ACUERDO|DECRETO)\s.{0,75}\bNo?[°º.]?\s*\d+.{0,20}\bDE\s+(19|20)\d{2}\b\)?\.?\s*(\(.*\))?$"
DATE_LINE = r"^\(\s*[A-Za-zÁÉÍÓÚáéíóú]+\.?\s+\d{1,2}\s*\)$"
RULE_LINE = r"^-{3,}$"
FOOTER = r"(Kil[óo]metro\s+\d+\s+V[íi]a\s+a\s+Puerto\s+L[óo]pez|Vereda\s+Barcelona|Conmutador\s*\d|^[\w.+-]+@[\w.-]+\.\w+$)"
CORRUPT = "[A-Za-zÁÉÍÓÚáéíóúÑñ][0-9]{1,2}[A-Za-zÁÉÍÓÚáéíóúÑñ]"
HEAD_ARTICLE = r"^###\s+ART[IÍ]CULO\s*(.*)$"
HEAD_PARAGRAPH = r"^####\s+PAR[AÁ]GRAFO\s*(.*)$"
HEAD_SECTION = r"^##\s+(.+)$"
DESCRIPTION = "[“\"«]\\s*(Por\\s[^”\"»]{15,400})[”\"»]"
IN_FORCE = r"(rige\s+a\s+partir[^.\n]{5,160}|entrar[áa]?\s+en\s+vigen[^.\n]{5,160})"
CITATION = r"N[°ºo\.]*\s*0*(\d{1,4})\s+de\s+(\d{4})"
