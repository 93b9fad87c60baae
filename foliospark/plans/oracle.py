"""The registered queries in DuckDB's SQL, as chains of common table expressions."""

from __future__ import annotations

from ..functions import vocab as v
from .adapters import DOC_TYPES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(map(_q, names)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _plain(x: str) -> str:
    for pattern, by in (("<!--.*?-->", ""), (r"^#{1,6}\s*", ""), ("</?[a-zA-Z][^>]*>", ""), ("[*`]+", ""), (r"_+|\\", " ")):
        x = f"regexp_replace({_strip(x) if pattern.startswith('<!') else x}, {_q(pattern)}, '{by}', 'g')"
    return _squeeze(x)


def _has(x: str, pattern: str, fold: bool = True) -> str:
    return f"regexp_matches({x}, {_q(('(?i)' if fold else '') + pattern)})"


def _group(x: str, pattern: str, i: int, fold: bool = True) -> str:
    return f"regexp_extract({x}, {_q(('(?i)' if fold else '') + pattern)}, {i})"


LABELS = "CASE doc_type " + " ".join(f"WHEN {_q(k)} THEN {_q(x)}" for k, x in v.TYPE_LABELS.items()) + " ELSE 'Circular Interna 3A' END"
NOISE = " OR ".join([_has("s", v.PAGE_NOISE), _has("s", v.DATE_LINE, False), _has("s", v.BANNER), _has("s", v.FOOTER)])
CORRUPT = f"""SELECT doc_id, coalesce(sum(n) FILTER (n >= 3), 0) >= 6 AS corrupt FROM (SELECT d.doc_id, g, count(g) AS n FROM documents d
  LEFT JOIN (SELECT doc_id, lower(unnest(regexp_extract_all(text, {_q(v.CORRUPT)}))) AS g FROM documents) USING (doc_id) GROUP BY 1, 2) GROUP BY doc_id"""
TOKENS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda t: t <> '')"

# Each entry may use those before it.
CHAIN = {
    "legal0": f"""SELECT doc_id, {_list(DOC_TYPES)}[doc_id % 8 + 1] AS kind, CAST(doc_id % 20 AS VARCHAR) AS num0, CAST(2000 + doc_id % 10 AS VARCHAR) AS year0,
  string_split(coalesce(text, ''), chr(10)) AS l FROM documents""",
    "legal": """SELECT doc_id, year0 || '/si/normatividad/' || kind || '/' || num0 || '_' || year0 || '_' || doc_id || '.pdf' AS path, array_to_string(list_concat(
  ['## **RESOLUCIÓN SUPERIOR No. ' || num0 || ' DE ' || year0 || '**', '( Mayo 05 )',
   CASE WHEN doc_id % 3 <> 0 THEN '“Por la cual se adopta ' || substring(l[1], 1, 60) || ' y se dictan otras disposiciones”' ELSE 'Sin epígrafe' END,
   '**CONSIDERANDO:**', l[1], 'Página 1 de 2', '---', CASE WHEN doc_id % 5 = 0 THEN 'R E S U E L V E' ELSE 'ACUERDA:' END, 'Disposición del documento ' || num0],
  list_transform(l[2:], lambda x, k: '**ARTÍCULO ' || CAST(k % 6 + 1 AS VARCHAR) || 'º.-** ' || x),
  ['PARÁGRAFO PRIMERO. Se aplica a todos', '| a | b |', 'Línea que se repite en todas las hojas', 'correo@example.edu', 'LÍNEA que se repite en todas las hojas',
   'CAPÍTULO II - Vigencia', 'La presente norma rige a partir de la fecha de su expedición']), chr(10)) AS raw_md FROM legal0""",
    "meta0": "SELECT doc_id, path, raw_md, string_split(path, '/') AS p FROM legal",
    "meta1": r"SELECT *, p[4] AS doc_type, p[1] AS year, p[5] AS source_filename, regexp_extract(p[5], '^(\d+)_', 1) AS number, p[1] || '/' || p[4] || '/' || regexp_replace(p[5], '\.pdf$', '.md') AS out_path FROM meta0",
    "meta": f"SELECT *, type_label || ' No. ' || number || ' de ' || year AS titulo FROM (SELECT *, {LABELS} AS type_label FROM meta1)",
    "ln": f"SELECT doc_id, pos, raw, {_plain('raw')} AS s, regexp_matches(raw, '^\\s*\\|') AS tab FROM (SELECT doc_id, unnest(string_split(raw_md, chr(10))) AS raw, unnest(range(len(string_split(raw_md, chr(10))))) AS pos FROM legal)",
    "keep1": f"SELECT *, CASE WHEN NOT tab AND length(s) >= 25 THEN lower(s) END AS k FROM ln WHERE tab OR NOT (regexp_matches(trim(raw), '^-{{3,}}$') OR {NOISE})",
    "keep": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS rn FROM keep1) WHERE k IS NULL OR rn = 1",
    "emit": f"""SELECT doc_id, pos, CASE WHEN tab THEN rtrim(raw)
  WHEN s = '' THEN ''
  WHEN {_has("s", v.SECTION)} THEN chr(10) || '## ' || upper(regexp_replace({_group("s", v.SECTION, 1)}, '\\s+', '', 'g')) || chr(10)
  WHEN {_has("s", v.CHAPTER)} THEN chr(10) || '## ' || upper({_group("s", v.CHAPTER, 1)}) || ' ' || upper({_group("s", v.CHAPTER, 2)}) || CASE WHEN {_group("s", v.CHAPTER, 3)} <> '' THEN ' — ' || {_group("s", v.CHAPTER, 3)} ELSE '' END
  WHEN {_has("s", v.ARTICLE)} THEN chr(10) || '### ARTÍCULO ' || upper({_group("s", v.ARTICLE, 2)}) || CASE WHEN {_group("s", v.ARTICLE, 3)} <> '' THEN chr(10) || {_group("s", v.ARTICLE, 3)} ELSE '' END
  WHEN {_has("s", v.PARAGRAPH)} THEN chr(10) || '#### PARÁGRAFO' || CASE WHEN {_group("s", v.PARAGRAPH, 2)} <> '' THEN ' ' || upper(trim({_group("s", v.PARAGRAPH, 2)})) ELSE '' END || CASE WHEN {_group("s", v.PARAGRAPH, 3)} <> '' THEN chr(10) || {_group("s", v.PARAGRAPH, 3)} ELSE '' END
  ELSE s END AS o FROM keep""",
    "norm": f"SELECT doc_id, {_strip('regexp_replace(string_agg(o, chr(10) ORDER BY pos), chr(10) || chr(123) || chr(51) || chr(44) || chr(125), chr(10) || chr(10), chr(103))')} AS body0 FROM emit GROUP BY doc_id",
    "doc": "SELECT m.*, '# ' || titulo || chr(10) || chr(10) || body0 || chr(10) AS body FROM meta m JOIN norm USING (doc_id)",
    "cl0": "SELECT doc_id, unnest(string_split(rtrim(body, chr(10)), chr(10))) AS raw, unnest(range(len(string_split(rtrim(body, chr(10)), chr(10))))) AS ix FROM doc",
    "cl1": f"""SELECT doc_id, ix, rtrim(raw) AS s, CASE WHEN raw LIKE '# %' THEN 'title' WHEN {_has("raw", v.HEAD_ARTICLE)} THEN 'article' WHEN {_has("raw", v.HEAD_PARAGRAPH)} THEN 'content' WHEN {_has("raw", v.HEAD_SECTION, False)} THEN 'section' ELSE 'content' END AS kind FROM cl0""",
    "cl": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS pos, kind,
  CASE kind WHEN 'article' THEN trim(regexp_replace(trim({_group("s", v.HEAD_ARTICLE, 1)}), '^[.:°º\\-–) ]+|[.:°º\\-–) ]+$', '', 'g')) WHEN 'section' THEN upper(trim({_group("s", v.HEAD_SECTION, 1, False)})) END AS name,
  CASE WHEN {_has("s", v.HEAD_PARAGRAPH)} THEN 'Parágrafo' || CASE WHEN trim({_group("s", v.HEAD_PARAGRAPH, 1)}) <> '' THEN ' ' || trim({_group("s", v.HEAD_PARAGRAPH, 1)}) ELSE '' END || ':' ELSE s END AS text FROM cl1 WHERE kind <> 'title'""",
    "blk": "SELECT *, sum(CASE WHEN kind <> 'content' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM cl",
    "art0": f"SELECT doc_id, b, max(name) FILTER (kind = 'article') AS num, {_squeeze('coalesce(string_agg(text, chr(32) ORDER BY pos) FILTER (kind = chr(99) || chr(111) || chr(110) || chr(116) || chr(101) || chr(110) || chr(116)), chr(32))')} AS content, bool_or(kind = 'article') AS is_art, max(name) FILTER (kind = 'section') AS sec, count(*) FILTER (kind = 'content') AS n FROM blk GROUP BY doc_id, b",
    "art": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS pos, num, content FROM art0 WHERE is_art AND content <> ''",
    "sec": "SELECT doc_id, sec, trim(string_agg(content, ' ' ORDER BY b)) AS t, sum(n) AS n FROM art0 WHERE sec IS NOT NULL GROUP BY doc_id, sec",
    "head": f"SELECT doc_id, {_squeeze(_group('string_agg(text, chr(32) ORDER BY pos)', v.DESCRIPTION, 1))} AS descripcion FROM blk WHERE b = 0 GROUP BY doc_id",
    "st": """SELECT d.doc_id, coalesce(h.descripcion, '') AS descripcion, coalesce(c.t, '') AS considerando,
  CASE WHEN coalesce(r.n, 0) > 0 THEN r.t ELSE coalesce(a.t, '') END AS resuelve, (SELECT count(*) FROM art WHERE art.doc_id = d.doc_id) AS n_articles
  FROM doc d LEFT JOIN head h USING (doc_id) LEFT JOIN sec c ON c.doc_id = d.doc_id AND c.sec = 'CONSIDERANDO' LEFT JOIN sec r ON r.doc_id = d.doc_id AND r.sec = 'RESUELVE' LEFT JOIN sec a ON a.doc_id = d.doc_id AND a.sec = 'ACUERDA'""",
    "ref0": f"""SELECT doc_id, path, body, doc_type AS tipo, list_contains({_list(v.SKIP_TYPES)}, doc_type) AS skipped, titulo AS cita, source_filename AS source,
  CASE WHEN m THEN 'el' ELSE 'la' END AS el, CASE WHEN m THEN 'El' ELSE 'La' END AS al, CASE WHEN m THEN 'del' ELSE 'de la' END AS del_,
  CASE WHEN n THEN '' ELSE {_q(v.SHORT_SUFFIX)} END AS suffix, CASE WHEN n THEN '' ELSE {_q(v.LONG_SUFFIX)} END AS entity
  FROM (SELECT *, regexp_matches(lower(type_label), '^({"|".join(v.MASCULINE)})') AS m, regexp_matches(upper(doc_type), '{"|".join(v.NATIONAL_HINTS)}') AS n FROM doc)""",
    "ref": "SELECT * FROM ref0 WHERE NOT skipped",
    "num0": f"""SELECT doc_id, pos, content, CASE WHEN regexp_matches(num, '^\\d{{1,3}}$') THEN num WHEN regexp_matches(num, '(?i)^[IVXLCDM]+$') AND length(num) <= 5 THEN upper(num) WHEN list_contains({_list(v.ORDINAL_WORDS)}, lower(num)) THEN lower(num) ELSE '' END AS own,
  regexp_extract(content, '^\\s*(\\d{{1,3}})[.\\)]', 1) AS lead FROM art""",
}

RECURSIVE = """walk(doc_id, pos, seen, num) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM rooms
  UNION ALL
  SELECT doc_id, pos, CASE WHEN ok THEN list_append(seen, num) ELSE seen END, CASE WHEN ok THEN num END FROM (
    SELECT doc_id, pos, seen, num, len(seen) < room AND NOT list_contains(seen, num) AS ok FROM (
      SELECT n.doc_id, n.pos, w.seen, r.room, CASE WHEN own <> '' AND NOT list_contains(w.seen, own) THEN own WHEN lead <> '' AND NOT list_contains(w.seen, lead) THEN lead ELSE CAST(n.pos + 1 AS VARCHAR) END AS num
      FROM walk w JOIN num0 n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1 JOIN rooms r ON r.doc_id = n.doc_id)))"""
PAIRS = f"""named AS (SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) - 1 AS k, w.num, a.content FROM walk w JOIN art a ON a.doc_id = w.doc_id AND a.pos = w.pos WHERE w.num IS NOT NULL),
full_ AS (SELECT r.*, s.descripcion, s.considerando, s.resuelve, s.n_articles, a.num AS num1, a.content AS content1 FROM ref r JOIN st s USING (doc_id) LEFT JOIN art a ON a.doc_id = r.doc_id AND a.pos = 0),
intro AS (SELECT *, al || ' ' || cita || entity || ' es la norma «' || descripcion || '».' || CASE WHEN n_articles > 0 THEN ' En su artículo ' || coalesce(nullif(num1, ''), '1') || ' establece: ' || content1 ELSE '' END AS a0,
  coalesce(nullif(resuelve, ''), nullif(considerando, ''), descripcion) AS t FROM full_),
every AS (
  SELECT doc_id, 0 AS o, '¿De qué trata ' || el || ' ' || cita || suffix || '?' AS question, a0 AS answer FROM intro WHERE descripcion <> ''
  UNION ALL SELECT doc_id, 1, '¿Qué regula ' || el || ' ' || cita || suffix || '?', a0 FROM intro WHERE descripcion <> ''
  UNION ALL SELECT doc_id, 10 + k, '¿Qué establece el artículo ' || num || ' ' || del_ || ' ' || cita || suffix || '?', 'Según el artículo ' || num || ' ' || del_ || ' ' || cita || entity || ', se establece: ' || content FROM named JOIN ref USING (doc_id)
  UNION ALL SELECT doc_id, 100, '¿Qué dispone ' || el || ' ' || cita || suffix || '?', al || ' ' || cita || entity || ' dispone: ' || substring(t, 1, 1200) FROM intro WHERE n_articles = 0 AND t <> '' AND descripcion = ''
  UNION ALL SELECT doc_id, 101, '¿Cuál es el fundamento ' || del_ || ' ' || cita || suffix || '?', al || ' ' || cita || entity || ' considera: ' || substring(considerando, 1, 1200) FROM intro WHERE n_articles = 0 AND t <> '' AND considerando <> ''
  UNION ALL SELECT doc_id, 200, '¿Desde cuándo rige ' || el || ' ' || cita || suffix || '?', al || ' ' || cita || entity || ' ' || trim({_group("body", v.IN_FORCE, 1)}) || '.' FROM intro WHERE {_has("body", v.IN_FORCE)}),
qa AS (SELECT doc_id, path, tipo, CAST(pair_idx AS INTEGER) AS pair_idx, question, answer, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS pair_idx FROM every) JOIN ref USING (doc_id) WHERE pair_idx < 10)"""
FIRST = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY string_split(path, '/'), pair_idx) AS rn FROM qa) WHERE rn = 1)"


def _chain(last: str) -> str:
    names = list(CHAIN)
    return ",\n".join(f"{n} AS ({CHAIN[n]})" for n in names[: names.index(last) + 1])


def _with(last: str, select: str) -> str:
    return f"WITH {_chain(last)}\n{select}"


def _numbered(select: str, room: str = "9") -> str:
    rooms = f"rooms AS (SELECT doc_id, CAST({room} AS INTEGER) AS room FROM st)"
    return f"WITH RECURSIVE {_chain('num0')},\n{rooms},\n{RECURSIVE}\n{select}"


def _qa(select: str, more: str = "") -> str:
    rooms = "rooms AS (SELECT doc_id, CASE WHEN descripcion <> '' THEN 7 ELSE 9 END AS room FROM st)"
    return f"WITH RECURSIVE {_chain('num0')},\n{rooms},\n{RECURSIVE},\n{PAIRS}{',' + more if more else ''}\n{select}"


TEXT_LINES = f"""SELECT doc_id, pos, raw, {_plain('raw')} AS s FROM (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
EVAL = """pairs AS (SELECT a.conv_id || '-' || a.turn AS example_id,
  CASE a.conv_id % 4 WHEN 0 THEN 'Resolución No. 7 de 1990 ' WHEN 1 THEN 'Acuerdo No. 13 de 2004 ' WHEN 2 THEN 'Acuerdo 3 de 2001 ' ELSE '' END || u.text AS reference,
  CASE a.conv_id % 4 WHEN 0 THEN 'Según la Resolución 007 de 1990, ' WHEN 1 THEN 'El Acuerdo No. 12 de 2004 dice: ' WHEN 2 THEN 'Ley 30 de 1992: ' ELSE 'no tengo información: ' END || a.text AS prediction
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"""
GRAMS = f"""{EVAL}, words AS (SELECT example_id, {TOKENS.format('prediction')} AS p, {TOKENS.format('reference')} AS r FROM pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
g0 AS (SELECT example_id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS g, 1 AS p, 0 AS r FROM words, ns WHERE len(p) >= n
  UNION ALL SELECT example_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g, 0, 1 FROM words, ns WHERE len(r) >= n),
g AS (SELECT example_id, n, g, sum(p) AS p, sum(r) AS r FROM g0 GROUP BY ALL)"""
CIDER = f"""{GRAMS}, df AS (SELECT n, g, count(*) AS df FROM g WHERE r > 0 GROUP BY ALL), total AS (SELECT count(*) AS total FROM pairs),
w AS (SELECT example_id, n, p * idf AS a, r * idf AS b FROM (SELECT g.*, ln((total + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM g LEFT JOIN df USING (n, g), total)),
c AS (SELECT sum(CASE WHEN aa > 0 AND bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END) AS s FROM (SELECT example_id, n, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM w GROUP BY ALL)),
cid AS (SELECT s / (total * 4) AS cider FROM c, total)"""
MI = f"""{GRAMS}, u AS (SELECT example_id, p, r, sum(p) OVER (PARTITION BY example_id) AS tp, sum(r) OVER (PARTITION BY example_id) AS tr FROM g WHERE n = 1),
m AS (SELECT example_id, sum(CASE WHEN p > 0 THEN p / (tp + tr) * ln((p / (tp + tr)) / ((tp / (tp + tr)) * ((p + r) / (tp + tr)))) ELSE 0 END + CASE WHEN r > 0 THEN r / (tp + tr) * ln((r / (tp + tr)) / ((tr / (tp + tr)) * ((p + r) / (tp + tr)))) ELSE 0 END) AS mi FROM u WHERE tp > 0 AND tr > 0 GROUP BY 1)"""


def _cites(c: str) -> str:
    rx = _q("(?i)" + v.CITATION)
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, {rx}), lambda x: coalesce(nullif(ltrim(regexp_extract(x, {rx}, 1), '0'), ''), '0') || '/' || regexp_extract(x, {rx}, 2))))"


ADMITS = " OR ".join(f"contains(lower(prediction), {_q(p)})" for p in v.ADMISSIONS)
ROUTED = f"""c AS ({CORRUPT}), r AS (SELECT doc_id, text, CASE WHEN length(text) < 50 THEN 'escaneado_omitido' WHEN corrupt THEN 'corrupto_omitido' WHEN length(text) < 100 THEN 'vacio_a_ocr' ELSE 'digital' END AS route, corrupt FROM documents JOIN c USING (doc_id))"""
RUN_FILES = f"""{ROUTED}, f AS (SELECT text, CASE WHEN doc_id % 8 = 5 THEN 'filtrado' WHEN doc_id % 20 = 4 THEN 'ya_procesado' WHEN doc_id % 7 = 3 THEN 'errores' ELSE route END AS route FROM r)"""
ROUGE_WORDS = r"list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
TURNS = """t0 AS (SELECT *, lead(role) OVER w AS r1, lead(text) OVER w AS t1 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, text AS u, CASE WHEN r1 = 'assistant' THEN t1 END AS a FROM t0 WHERE role = 'user'),
past AS (SELECT x.conv_id, x.turn, x.u, list(y.u || '|' || y.a ORDER BY y.turn) FILTER (y.a IS NOT NULL) AS h, list('user:' || y.u || '|assistant:' || y.a ORDER BY y.turn) FILTER (y.a IS NOT NULL) AS m
  FROM turns x LEFT JOIN turns y ON x.conv_id = y.conv_id AND y.turn < x.turn GROUP BY ALL)"""

# The longest common subsequence: a row of the table for each word of the reference, each entry the running maximum.
ROUGE = f"""{EVAL}, rt AS (SELECT example_id, {ROUGE_WORDS.format('prediction')} AS p, {ROUGE_WORDS.format('reference')} AS r FROM pairs),
walk(example_id, p, r, i, t) AS (SELECT example_id, p, r, 0, list_transform(p, lambda x: 0) FROM rt UNION ALL
  SELECT example_id, p, r, i + 1, list_transform(range(1, len(p) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT example_id, p, r, i, list_transform(range(1, len(p) + 1), lambda k: greatest(t[k], CASE WHEN k > 1 THEN t[k - 1] ELSE 0 END + CASE WHEN p[k] = r[i + 1] THEN 1 ELSE 0 END)) AS c FROM walk WHERE i < len(r))),
rouge AS (SELECT example_id, CASE WHEN len(p) + len(r) = 0 THEN 0.0 ELSE 2.0 * coalesce(t[len(p)], 0) / (len(p) + len(r)) END AS rouge FROM walk WHERE i = len(r))"""


def _bleu_words(x: str) -> str:
    for find, by in (("<skipped>", "''"), ("-\n", "''"), ("\n", "' '"), ("&quot;", "chr(34)"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        x = f"replace({x}, {_q(find)}, {by})"
    x = f"' ' || {x} || ' '"
    for pattern, by in ((r"([!-+:-@\[-`{-~/ ])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(by)}, 'g')"
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


BLEU = f"""{EVAL}, bt AS (SELECT example_id, {_bleu_words('prediction')} AS p, {_bleu_words('reference')} AS r FROM pairs), bn AS (SELECT unnest([1, 2, 3, 4]) AS n),
b0 AS (SELECT example_id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: p[i:i + n - 1])) AS g, 1 AS p, 0 AS r FROM bt, bn WHERE len(p) >= n
  UNION ALL SELECT example_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: r[i:i + n - 1])), 0, 1 FROM bt, bn WHERE len(r) >= n),
b1 AS (SELECT n, sum(least(p, r)) AS m, sum(p) AS t, sum(r) AS w FROM (SELECT example_id, n, g, sum(p) AS p, sum(r) AS r FROM b0 GROUP BY ALL) GROUP BY n),
b2 AS (SELECT n, m, t, sum(CASE WHEN m = 0 AND t > 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM b1),
b3 AS (SELECT sum(ln(CASE WHEN m > 0 THEN 100.0 * m / t ELSE 100.0 / (power(2, z) * greatest(t, 1)) END)) / 4 AS l FROM b2),
bleu AS (SELECT CASE WHEN coalesce(m, 0) = 0 THEN 0.0 ELSE (CASE WHEN t >= w THEN 1.0 ELSE exp(1 - w / t) END) * exp(l) END AS bleu FROM b1, b3 WHERE n = 1)"""
RUNS = f"""{RUN_FILES} SELECT {', '.join(f"count(*) FILTER (route = {_q(r)}) AS {r}" for r in ('digital', 'ocr', 'escaneado_omitido', 'corrupto_omitido', 'vacio_a_ocr', 'filtrado', 'ya_procesado', 'errores'))}, with_ocr FROM (
  SELECT false AS with_ocr, route FROM f UNION ALL SELECT true, CASE WHEN route IN ('escaneado_omitido', 'corrupto_omitido', 'vacio_a_ocr') THEN CASE WHEN strlen(text) % 2 = 0 THEN 'ocr' ELSE 'vacio_a_ocr' END ELSE route END FROM f) GROUP BY with_ocr"""

SQL = {
    "path_meta": _with("meta", "SELECT doc_id, doc_type, type_label, year, number, source_filename, titulo, out_path FROM meta"),
    "scope_filter": _with("meta", "SELECT doc_id, doc_type, year FROM meta WHERE doc_type IN ('LEY', 'RESOLUCION_SUPERIOR') AND year IN ('2000', '2002')"),
    "anti_skip": _with("meta", "SELECT doc_id, out_path FROM meta WHERE doc_id % 4 <> 0"),
    "limit_written": _with("legal", "SELECT doc_id, path, ok FROM (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l.doc_id, path, length(text) >= 100 AS ok FROM legal l JOIN documents USING (doc_id))) WHERE before < 50"),
    "path_order": _with("legal", "SELECT doc_id, path, row_number() OVER (ORDER BY string_split(path, '/')) AS rank FROM legal"),
    "is_digital": "SELECT source, avg(length(text)) >= 50 AS is_digital FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source",
    "is_digital_docs": "SELECT doc_id, doc_id % 3 <> 0 AND length(coalesce(text, '')) >= 50 AS is_digital FROM documents",
    "run_stats": f"WITH {RUNS}",
    "looks_corrupt": CORRUPT,
    "route": f"WITH {ROUTED} SELECT doc_id, route, route <> 'digital' AS queued FROM r",
    "route_ocr": f"WITH {ROUTED} SELECT doc_id, CASE WHEN route = 'digital' THEN 'digital' WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'vacio_a_ocr' END AS route, false AS queued FROM r",
    "route_stats": f"WITH {ROUTED} SELECT {', '.join(f'count(*) FILTER (route = {_q(r)}) AS {r}' for r in ('digital', 'ocr', 'escaneado_omitido', 'corrupto_omitido', 'vacio_a_ocr', 'filtrado', 'ya_procesado', 'errores'))} FROM r",
    "strip_decoration": f"SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_matches(raw, '^\\s*\\|') AS is_table, {_plain('raw')} AS s FROM (SELECT page_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT page_id, string_split(rtrim(html, chr(10)), chr(10)) AS l FROM pages))",
    "line_frequency": f"SELECT doc_id, lower(s) AS key, count(*) AS n FROM ({TEXT_LINES}) WHERE NOT regexp_matches(raw, '^\\s*\\|') AND length(s) >= 25 GROUP BY ALL",
    "noise_drop": _with("ln", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, s FROM ln WHERE {NOISE}"),
    "normalized_md": _with("norm", "SELECT doc_id, body0 AS body FROM norm"),
    "normalized_text": "WITH " + _chain("norm").replace("raw_md, chr(10)", "text, chr(10)").replace("FROM legal)", "FROM documents)") + "\nSELECT doc_id, body0 AS body FROM norm",
    "frontmatter": _with("doc", "SELECT doc_id, doc_type AS tipo, type_label AS tipo_legible, number AS numero, year AS anio, titulo, source_filename AS fuente, path AS ruta_origen, 'pymupdf4llm' AS metodo_extraccion, '1' AS paginas, CAST(length(raw_md) AS VARCHAR) AS caracteres, length(body) AS body_chars FROM doc"),
    "classify_lines": _with("cl", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, name, text FROM cl"),
    "articles": _with("art", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, num, content FROM art"),
    "doc_structure": _with("st", "SELECT doc_id, descripcion, considerando, resuelve, CAST(n_articles AS INTEGER) AS n_articles FROM st"),
    "citation_ref": _with("ref0", "SELECT doc_id, tipo, cita, source, el, al, del_, suffix, entity, skipped FROM ref0"),
    "article_numbers": _numbered("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, num FROM walk WHERE num IS NOT NULL"),
    "qa_pairs": _qa("SELECT * FROM qa"),
    "qa_template": _with("ref", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pair_idx, '[PREGUNTA ' || i || ' sobre ' || cita || ']' AS question, '[RESPUESTA ' || i || ' — completar con información de ' || cita || ']' AS answer, source FROM ref, (SELECT unnest([1, 2, 3, 4, 5]) AS i)"),
    "alpaca": _qa("SELECT question AS instruction, '' AS input, answer AS output FROM qa"),
    "sharegpt": _qa("SELECT CAST(to_json([{'from': 'human', 'value': question}, {'from': 'gpt', 'value': answer}]) AS VARCHAR) AS conversations FROM qa"),
    "dedupe_first": _qa("SELECT doc_id, pair_idx, question, answer FROM one", FIRST),
    "duplicate_count": _qa("SELECT count(*) - count(DISTINCT question) AS duplicates FROM qa"),
    "pairs_by_type": _qa("SELECT r.tipo, (SELECT count(*) FROM qa WHERE qa.tipo = r.tipo) AS n_pairs, (SELECT count(*) FROM one WHERE one.tipo = r.tipo) AS n_kept FROM (SELECT DISTINCT tipo FROM ref0) r", FIRST),
    "formatted": _qa("""SELECT 'alpaca' AS format, CAST(to_json({'instruction': question, 'input': '', 'output': answer}) AS VARCHAR) AS record FROM qa WHERE tipo IN ('LEY', 'Plan')
  UNION ALL SELECT 'sharegpt', CAST(to_json({'conversations': [{'from': 'human', 'value': question}, {'from': 'gpt', 'value': answer}]}) AS VARCHAR) FROM qa WHERE tipo IN ('LEY', 'Plan')"""),
    "split_hash": _qa("SELECT question, CASE WHEN row_number() OVER (ORDER BY md5('42:' || question), question) <= floor(count(*) OVER () * 0.30) THEN 'test' ELSE 'train' END AS split FROM one", FIRST),
    "training_text": _qa(f"SELECT '<|im_start|>system' || chr(10) || {_q(v.TRAINING_PROMPT)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) AS text FROM qa"),
    "chat_history": f"WITH {TURNS} SELECT conv_id, turn, coalesce(array_to_string(h[-2:], '||'), '') AS history FROM past",
    "prompt_messages": f"WITH {TURNS} SELECT conv_id, turn, CAST(2 + 2 * coalesce(len(m[-5:]), 0) AS INTEGER) AS n, 'system:' || {_q(v.SYSTEM_PROMPT)} || '|' || coalesce(array_to_string(m[-5:], '|') || '|', '') || 'user:' || u AS messages FROM past",
    "history_since_reset": f"""WITH {TURNS}, kept AS (SELECT * FROM turns WHERE conv_id % 2 <> 0 OR turn > 2),
  done AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM kept WHERE a IS NOT NULL),
  upto AS (SELECT x.conv_id, x.turn, max(y.k) AS k FROM kept x LEFT JOIN done y ON x.conv_id = y.conv_id AND y.turn < x.turn GROUP BY ALL)
  SELECT upto.conv_id, upto.turn, CASE WHEN upto.k > 3 THEN 3 ELSE coalesce(upto.k, 0) END AS n, coalesce(o.u, '') AS oldest FROM upto LEFT JOIN done o ON o.conv_id = upto.conv_id AND o.k = CASE WHEN upto.k > 2 THEN upto.k - 2 WHEN upto.k > 0 THEN 1 END""",
    "answers": f"""WITH {TURNS} SELECT conv_id, turn, CAST(2 + 2 * least(coalesce(len(h), 0), 2) AS VARCHAR) || ' mensajes, ' || substring(u, 1, 20) || ', 0.7' AS answer, 'stub' AS model_used FROM past
  UNION ALL SELECT conv_id, turn, {_q(v.NO_MODEL)}, 'sin modelo' FROM past""",
    "batch_answers": "SELECT conv_id, turn, '2 mensajes, ' || substring(text, 1, 20) || ', 0.0' AS answer, '' AS model_used FROM conversations WHERE role = 'user'",
    "conv_title": "SELECT conv_id, CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '...' ELSE t END AS title FROM (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    "citations": f"WITH {EVAL} SELECT example_id, array_to_string({_cites('reference')}, ',') AS r, array_to_string({_cites('prediction')}, ',') AS p FROM pairs",
    "citation_accuracy": f"WITH {EVAL} SELECT coalesce(avg(CASE WHEN list_has_any(r, p) THEN 1.0 ELSE 0.0 END), 0.0) AS exactitud_citas FROM (SELECT {_cites('reference')} AS r, {_cites('prediction')} AS p FROM pairs) WHERE len(r) > 0",
    "no_answer_rate": f"WITH {EVAL} SELECT avg(CASE WHEN {ADMITS} THEN 0.0 ELSE 1.0 END) AS tasa_alucinacion FROM pairs",
    "ngram_counts": f"WITH {GRAMS} SELECT example_id, g AS gram, CAST(p AS BIGINT) AS n FROM g WHERE n = 2 AND p > 0",
    "cider": f"WITH {CIDER} SELECT round(cider, 6) AS cider FROM cid",
    "vocab_mi": f"WITH {MI} SELECT example_id, round(coalesce(mi, 0.0), 6) AS mi FROM pairs LEFT JOIN m USING (example_id)",
    "rouge_l": f"WITH RECURSIVE {ROUGE} SELECT example_id, round(rouge, 6) AS rouge_l FROM rouge",
    "bleu": f"WITH {BLEU} SELECT round(bleu, 6) AS bleu FROM bleu",
    "answer_losses": f"""WITH {EVAL}, w AS (SELECT example_id, list_transform(string_split(reference, ' ')[1:9], lambda x: length(x)) AS n FROM pairs)
  SELECT example_id, round(list_avg(n), 6) AS nll, round(list_avg(n) / 2, 6) AS entropy FROM w""",
    "mean_similarity": f"WITH {EVAL} SELECT round(avg(least(length(prediction), length(reference)) / greatest(length(prediction), length(reference), 1)), 6) AS bertscore_f1 FROM pairs",
    "eval_row": f"""SELECT '2024-01-01 00:00' AS fecha, 'stub' AS checkpoint, CAST((SELECT count(*) FROM (WITH {EVAL} SELECT * FROM pairs)) AS INTEGER) AS n_prueba, CAST(NULL AS VARCHAR) AS epochs,
  CAST(NULL AS VARCHAR) AS learning_rate, 16 AS rank, 32 AS lora_alpha, CAST(0.05 AS DOUBLE) AS lora_dropout, CAST(NULL AS DOUBLE) AS bertscore_f1,
  (SELECT round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0) AS coseno_sem,
  (SELECT round(avg(rouge), 4) FROM (WITH RECURSIVE {ROUGE} SELECT rouge FROM rouge)) AS rouge_l, (SELECT round(bleu, 2) FROM (WITH {BLEU} SELECT bleu FROM bleu)) AS bleu,
  (SELECT round(cider, 4) FROM (WITH {CIDER} SELECT cider FROM cid)) AS cider,
  (SELECT round(avg((doc_id % 17 + 1) / 8.0), 4) FROM documents) AS perdida, (SELECT round(exp(avg((doc_id % 17 + 1) / 8.0)), 2) FROM documents) AS perplejidad, (SELECT round(avg((doc_id % 11 + 1) / 4.0), 4) FROM documents) AS entropia,
  (SELECT round(avg(coalesce(mi, 0.0)), 4) FROM (WITH {MI} SELECT mi FROM pairs LEFT JOIN m USING (example_id))) AS info_mutua,
  (SELECT round(coalesce(avg(CASE WHEN list_has_any(r, p) THEN 1.0 ELSE 0.0 END), 0.0), 4) FROM (WITH {EVAL} SELECT {_cites('reference')} AS r, {_cites('prediction')} AS p FROM pairs) WHERE len(r) > 0) AS exactitud_citas,
  (SELECT round(avg(a), 4) FROM (WITH {EVAL} SELECT CASE WHEN {ADMITS} THEN 0.0 ELSE 1.0 END AS a FROM pairs)) AS tasa_alucinacion""",
    "embedding_cosine": "SELECT round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS coseno_sem FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0",
    "perplexity": "SELECT round(avg(nll), 6) AS perdida, round(exp(avg(nll)), 6) AS perplejidad, round(avg(entropy), 6) AS entropia FROM (SELECT (doc_id % 17 + 1) / 8.0 AS nll, (doc_id % 11 + 1) / 4.0 AS entropy FROM documents)",
}
