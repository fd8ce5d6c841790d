"""Registered queries over text functions and path lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import languages as L
from ..functions import prompts as P
from ..functions import text as X
from ..operators import corpus, inference, structure
from ..session import scratch_dir
from ..sources import files as SRC
from .base import code_files, sql_text, table, with_files

WS = sql_text(C.WHITESPACE)
EXTENSIONS = [
    ".py", ".JS", ".mjs", ".tsx", ".h", ".hpp", ".cs", ".php", ".rb", ".rs", ".tar.gz", ".pyi",
    ".R", ".unknown", "", ".kt", ".sh", ".yml", ".html", ".scss", ".md", ".tgz", ".json",
    ".csv", ".png", ".c", ".jpg.gz", ".swift",
]
_N = len(EXTENSIONS) + 2
_EXT_CASE = "CASE doc_id % {n} {whens} END".format(
    n=_N, whens=" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
)
_ID = "cast(doc_id AS varchar(20))"
ANY_PATH = (
    f"CASE WHEN doc_id % {_N} = {_N - 2} THEN concat('lib/', source, '/Dockerfile') "
    f"WHEN doc_id % {_N} = {_N - 1} THEN concat('node_modules/', source, '/Makefile') "
    f"WHEN doc_id % 7 = 3 THEN concat('.cache/', source, '/f', {_ID}, {_EXT_CASE}) "
    f"ELSE concat('lib/', source, '/f', {_ID}, {_EXT_CASE}) END"
)
PATHS = f"paths AS (SELECT doc_id, {ANY_PATH} AS path FROM documents)"
BASE = "regexp_extract(path, '[^/]+$')"
SUFFIX = f"lower(regexp_extract({BASE}, '^.+(\\.[^.]+)$', 1))"


def _paths(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id"), F.expr(ANY_PATH).alias("path"), "text", "source"
    )


def _catalog_values(catalog) -> str:
    rows, n = [], 0
    for language, keys in catalog.items():
        for key in keys:
            rows.append(f"('{key}', '{language}', {n})")
            n += 1
    return ", ".join(rows)


def _language_sql(catalog, names: bool) -> str:
    on = f"k.ext = {SUFFIX}" + (f" OR k.ext = {BASE}" if names else "")
    return f"""WITH {PATHS}, k(ext, language, ord) AS (VALUES {_catalog_values(catalog)})
SELECT doc_id, path, coalesce(arg_min(k.language, k.ord), 'none') AS language
FROM paths LEFT JOIN k ON {on} GROUP BY doc_id, path"""


def _language(catalog):
    def run(spark, sf):
        lang = L.detect_language(F.col("path"), catalog)
        return _paths(spark, sf).select(
            "doc_id", "path", F.coalesce(lang, F.lit("none")).alias("language")
        )
    return run


def b3(spark, sf):
    lang = L.detect_language(F.col("path"), "extended")
    return (
        _paths(spark, sf).withColumn("language", lang)
        .groupBy("language").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("language").isNotNull())
        .withColumn("extension", L.primary_extension(F.col("language")))
    )


_FIRST_EXT = ", ".join(f"('{k}', '{v[0]}')" for k, v in C.EXTENDED_LANGUAGES.items())
B3_SQL = f"""WITH x AS ({_language_sql(C.EXTENDED_LANGUAGES, True)}),
e(language, extension) AS (VALUES {_FIRST_EXT})
SELECT x.language, e.extension, count(*) AS n FROM x JOIN e USING (language) GROUP BY ALL"""


def b4(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.content_hash(F.col("text")).alias("hash")
    )


def b5(spark, sf):
    normal = X.normalize_code(F.col("content"), F.col("language"))
    return code_files(spark, sf).select(
        "file_id", F.md5(normal).alias("hash"), F.length(normal).alias("n_chars")
    )


B5_SQL = with_files(f"""
SELECT file_id, md5(t) AS hash, length(t) AS n_chars FROM (
  SELECT file_id, array_to_string(list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(c, '(?s)/\\*.*?\\*/', '', 'g'),
      '(?s)""\".*?""\"', '', 'g'), '(?s)''''''.*?''''''', '', 'g'), chr(10)),
    lambda l: trim(l, {WS})), lambda l: l <> ''), chr(10)) AS t
  FROM (SELECT file_id, CASE
    WHEN language IN ('python', 'ruby') THEN regexp_replace(content, '(?m)#.*$', '', 'g')
    WHEN language IN ('javascript', 'typescript', 'java', 'go')
      THEN regexp_replace(content, '(?m)//.*$', '', 'g')
    ELSE content END AS c FROM code_files))""")


def b6(spark, sf):
    found = X.extract_imports(F.col("content"), F.col("language"))
    return code_files(spark, sf).select("file_id", F.posexplode(found).alias("pos", "import"))


B6_SQL = with_files(f"""
SELECT file_id, CAST(pos - 1 AS INT) AS pos, i[pos] AS "import" FROM (
  SELECT file_id, i, unnest(range(1, len(i) + 1)) AS pos FROM (SELECT file_id, CASE language
    WHEN 'python' THEN list_transform(range(1, len(m) + 1), lambda k:
      CASE WHEN m[k] = '' OR m[k] IS NULL THEN n[k] ELSE concat(m[k], '.', n[k]) END)
    WHEN 'javascript' THEN list_concat(e, r) WHEN 'typescript' THEN list_concat(e, r)
    WHEN 'go' THEN g WHEN 'java' THEN j ELSE [] END AS i
  FROM (SELECT file_id, language,
    regexp_extract_all(content, {sql_text('(?m)' + X.PYTHON_IMPORT)}, 1) AS m,
    regexp_extract_all(content, {sql_text('(?m)' + X.PYTHON_IMPORT)}, 2) AS n,
    regexp_extract_all(content, {sql_text(X.ES_IMPORT)}, 1) AS e,
    regexp_extract_all(content, {sql_text(X.REQUIRE)}, 1) AS r,
    regexp_extract_all(content, {sql_text('(?m)' + X.JAVA_IMPORT)}, 1) AS j,
    regexp_extract_all(content, {sql_text('(?m)' + X.GO_IMPORT)}, 1) AS g
  FROM code_files)))""")


def b7(spark, sf):
    counted = X.count_lines(F.col("content"))
    return code_files(spark, sf).select("file_id", counted.alias("c")).select("file_id", "c.*")


# Lines become letters, and the block comments of a file one regex over them:
# lower case does not close a block, upper case does.
B7_SQL = with_files(f"""
SELECT file_id, CAST(total AS INT) AS total,
  CAST(length(regexp_replace(outside, '[^cC]', '', 'g')) AS INT) AS code,
  CAST(length(replace(e, 'b', '')) - length(regexp_replace(outside, '[^cC]', '', 'g')) AS INT)
    AS comment
FROM (SELECT file_id, total, e, regexp_replace(e, '[oO][bcso]*[CSO]?', '', 'g') AS outside FROM (
  SELECT file_id, count(*) AS total, string_agg(
    CASE WHEN t = '' THEN 'b'
      WHEN starts_with(t, '#') OR starts_with(t, '//') OR starts_with(t, '*')
        THEN CASE WHEN closes THEN 'S' ELSE 's' END
      WHEN starts_with(t, '/*') OR starts_with(t, '""\"') OR starts_with(t, '''''''')
        THEN CASE WHEN closes THEN 'O' ELSE 'o' END
      ELSE CASE WHEN closes THEN 'C' ELSE 'c' END END, '' ORDER BY line_no) AS e
  FROM (SELECT file_id, line_no, trim(line, {WS}) AS t, contains(line, '*/')
    OR contains(line, '""\"') OR contains(line, '''''''') AS closes FROM lines)
  GROUP BY file_id))""", lines=True)


def b8(spark, sf):
    cut = X.truncate_code(F.col("content"))
    return code_files(spark, sf).select(
        "file_id", F.length(cut).alias("n"), F.md5(cut).alias("hash")
    )


B8_SQL = with_files("""
SELECT file_id, length(c) AS n, md5(c) AS hash FROM (SELECT file_id, CASE WHEN length(t) > 5000
    THEN concat(left(t, 5000), chr(10), '... [truncated]') ELSE t END AS c
  FROM (SELECT file_id, CASE WHEN len(a) > 50
      THEN concat(array_to_string(a[1:50], chr(10)), chr(10), '... [truncated]')
      ELSE content END AS t
    FROM (SELECT *, string_split(content, chr(10)) AS a FROM code_files)))""")


def b9(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.sanitize_filename(F.col("url")).alias("name")
    )


B9_SQL = "SELECT page_id, left(regexp_replace(url, '[^\\w\\-.]', '_', 'g'), 255) AS name FROM pages"

SSH_URL = (
    "concat('git@', regexp_replace(regexp_replace(url, '^https?://', ''), '/', ':'), '.git')"
)


def _urls(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", "url").unionByName(
        pages.select("page_id", F.expr(SSH_URL.replace("'/', ':'", "'/(.*)$', ':$1'")).alias("url"))
    )


URLS = f"urls AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, {SSH_URL} FROM pages)"


def b10(spark, sf):
    parsed = X.parse_git_url(F.col("url"))
    columns = ("provider", "owner", "repo", "protocol")
    return _urls(spark, sf).select("page_id", "url", parsed.alias("p")).select(
        "page_id", "url", *[F.coalesce(f"p.{c}", F.lit("-")).alias(c) for c in columns]
    )


B10_SQL = f"""WITH {URLS}, s AS (SELECT *,
    string_split(replace(replace(url, 'https://', ''), 'http://', ''), '/') AS w,
    string_split(replace(url, 'git@', ''), ':') AS g FROM urls),
  t AS (SELECT *, string_split(g[2], '/') AS h, starts_with(url, 'http') AS web FROM s)
SELECT page_id, url,
  coalesce(CASE WHEN web THEN CASE WHEN len(w) >= 3 THEN w[1] END
    WHEN len(g) >= 2 THEN g[1] END, '-') AS provider,
  coalesce(CASE WHEN web THEN CASE WHEN len(w) >= 3 THEN w[2] END
    WHEN len(g) >= 2 AND len(h) >= 2 THEN h[1] END, '-') AS owner,
  coalesce(CASE WHEN web THEN CASE WHEN len(w) >= 3 THEN replace(w[3], '.git', '') END
    WHEN len(g) >= 2 AND len(h) >= 2 THEN replace(h[2], '.git', '') END, '-') AS repo,
  CASE WHEN web THEN 'https' ELSE 'ssh' END AS protocol FROM t"""


def b11(spark, sf):
    return L.with_mime_type(_paths(spark, sf).select("doc_id", "path"))


_MIME = ", ".join(f"('{e}', '{m}')" for e, m in L.mime_table())
B11_SQL = f"""WITH {PATHS}, mimes(ext, mime) AS (VALUES {_MIME}),
  p AS (SELECT doc_id, path, regexp_replace(regexp_replace({BASE}, '\\.tgz$', '.tar.gz'),
    '\\.(gz|bz2|xz|br|Z)$', '') AS b FROM paths)
SELECT doc_id, path, coalesce(m.mime, 'application/octet-stream') AS mime
FROM p LEFT JOIN mimes m ON m.ext = lower(regexp_extract(b, '^.+(\\.[^.]+)$', 1))"""


def b12(spark, sf):
    return _urls(spark, sf).select("page_id", "url", X.repo_name(F.col("url")).alias("name"))


B12_SQL = f"""WITH {URLS} SELECT page_id, url,
  replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '.git', '') AS name FROM urls"""


def b13(spark, sf):
    repo, path = F.col("repo_id"), F.col("path")
    return code_files(spark, sf).select(
        "file_id",
        X.stable_id(repo, path).alias("file_key"),
        X.stable_id(repo, path, F.lit("main")).alias("function_key"),
        X.snippet_id(
            repo, path, F.when(F.col("language") == "python", F.lit("main")).otherwise(F.lit("")),
            F.lit(7),
        ).alias("snippet_key"),
    )


B13_SQL = with_files("""
SELECT file_id, md5(concat(repo_id, ':', path)) AS file_key,
  md5(concat(repo_id, ':', path, ':main')) AS function_key,
  md5(concat(repo_id, ':', path, ':', CASE WHEN language = 'python' THEN 'main' ELSE '7' END))
    AS snippet_key FROM code_files""")


def b14(spark, sf):
    return code_files(spark, sf).select(
        "file_id", X.snippet(F.col("content"), F.lit(2), F.lit(4)).alias("snippet")
    )


B14_SQL = with_files("""
SELECT file_id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS snippet
FROM code_files""")


def b15(spark, sf):
    level = F.upper(F.substring_index("o_orderpriority", "-", -1))
    shown = F.when(level == "URGENT", "error").when(level == "HIGH", "WARNING").when(
        level == "LOW", "info").otherwise(level)
    return table(spark, sf, "orders").select(
        "o_orderkey", X.external_severity(shown).alias("severity")
    )


B15_SQL = """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'high'
  WHEN o_orderpriority LIKE '%HIGH' THEN 'medium' WHEN o_orderpriority LIKE '%LOW' THEN 'low'
  ELSE 'medium' END AS severity FROM orders"""

SEVERITY_OF_ORDER = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' "
    "WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END"
)


def b16(spark, sf):
    severity = F.expr(SEVERITY_OF_ORDER)
    return (
        table(spark, sf, "orders").select(severity.alias("severity"))
        .withColumn("rank", X.severity_rank(F.col("severity")))
        .groupBy("severity", "rank").agg(F.count(F.lit(1)).alias("n"))
    )


B16_SQL = f"""SELECT severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2
  WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS rank, count(*) AS n
  FROM (SELECT {SEVERITY_OF_ORDER} AS severity FROM orders) GROUP BY ALL"""


def b18(spark, sf):
    chat = corpus.messages_from_turns(table(spark, sf, "conversations"), "conv_id")
    return corpus.format_examples(chat, "chat").select("conv_id", "text")


B18_SQL = """SELECT conv_id, string_agg(concat('<|', role, '|>', text), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id"""


def _instructions(spark, sf):
    turns = corpus.adjacent_turns(table(spark, sf, "conversations"), "conv_id")
    return turns.select(
        "conv_id", "turn", F.col("query").alias("instruction"),
        F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit("context")).alias("input"),
        F.col("response").alias("output"),
    )


PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def b19(spark, sf):
    return corpus.format_examples(_instructions(spark, sf), "instruction").select(
        "conv_id", "turn", "text"
    )


B19_SQL = f"""WITH {PAIRS} SELECT conv_id, turn, concat('### Instruction:', chr(10), query, chr(10),
  CASE WHEN turn % 2 = 0 THEN '' ELSE concat('### Input:', chr(10), 'context', chr(10)) END,
  '### Response:', chr(10), response) AS text FROM pairs"""


def b20(spark, sf):
    rows = _instructions(spark, sf)
    plain = corpus.format_examples(rows.withColumn("text", F.col("output")), "plain")
    return plain.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))


B20_SQL = f"""WITH {PAIRS} SELECT conv_id, CAST(sum(length(response)) AS BIGINT) AS chars
  FROM pairs GROUP BY conv_id"""

PROMPT_KINDS = ("security", "fix", "explain", "performance", "optimize", "complexity", "general")


def _extra(kind):
    if kind == "fix":
        return {"vulnerability_type": F.lit("XSS")}
    if kind == "explain":
        return {"vulnerability_type": F.lit("XSS"),
                "cwe_id": F.when(F.col("language") == "python", F.lit("79"))}
    if kind == "optimize":
        return {"target_metric": F.lit("memory")}
    return {}


def b21(spark, sf):
    files = code_files(spark, sf)
    code, language = F.col("content"), F.coalesce("language", F.lit("text"))
    prompts = [
        F.struct(
            F.lit(kind).alias("kind"),
            P.analysis_prompt(kind, code, language, **_extra(kind)).alias("prompt"),
        )
        for kind in PROMPT_KINDS
    ]
    fim = P.completion_prompt(
        F.col("path"), F.when(F.col("language") == "python", code).otherwise(F.lit(""))
    )
    prompts.append(F.struct(F.lit("complete").alias("kind"), fim.alias("prompt")))
    return files.select("file_id", F.inline(F.array(*prompts))).select(
        "file_id", "kind", F.md5("prompt").alias("hash"), F.length("prompt").alias("n")
    )


def _template_sql(kind: str) -> str:
    text = sql_text(P.TEMPLATES[kind])
    for name, value in (
        ("language", "coalesce(language, 'text')"), ("vulnerability_type", "'XSS'"),
        ("cwe_suffix", "CASE WHEN language = 'python' THEN ' (CWE-79)' ELSE '' END"),
        ("target_metric", "'memory'"), ("code", "content"),
    ):
        text = f"replace({text}, '{{{name}}}', {value})"
    if kind in P.SYSTEM_OF:
        head = sql_text(f"<s>[INST] <<SYS>>\n{P.SYSTEM_OF[kind]}\n<</SYS>>\n\n")
        text = f"concat({head}, {text}, ' [/INST]')"
    return f"SELECT file_id, '{kind}' AS kind, {text} AS prompt FROM code_files"


B21_SQL = with_files(
    "SELECT file_id, kind, md5(prompt) AS hash, length(prompt) AS n FROM ("
    + " UNION ALL ".join(_template_sql(k) for k in PROMPT_KINDS)
    + """ UNION ALL SELECT file_id, 'complete', CASE WHEN language = 'python'
      THEN concat('<fim_prefix>', path, '<fim_suffix>', content, '<fim_middle>')
      ELSE path END FROM code_files)"""
)

ANSWER = (
    "CASE event_id % 4 "
    "WHEN 0 THEN concat('{\"issues\": [{\"type\": \"a\"}, {\"type\": \"b\"}], "
    "\"overall_score\": ', cast(event_id % 100 AS varchar(20)), ', \"summary\": \"s\"}') "
    "WHEN 1 THEN concat('See:', chr(10), '```json', chr(10), '{\"issues\": [{\"type\": \"', "
    "event_type, '\"}]}', chr(10), '```') "
    "WHEN 2 THEN concat('no json ', props) ELSE props END"
)


def b22(spark, sf):
    answers = table(spark, sf, "events").select("event_id", F.expr(ANSWER).alias("answer"))
    parsed = answers.withColumn("p", P.parse_output(F.col("answer"), "performance"))
    return parsed.select(
        "event_id",
        P.items_found(F.col("p"), "performance").alias("issues_found"),
        P.overall_score(F.col("p")).alias("overall_score"),
        F.coalesce("p.raw_response", F.lit("")).alias("raw_response"),
    )


B22_SQL = f"""SELECT event_id,
  CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS issues_found,
  CAST(CASE event_id % 4 WHEN 0 THEN event_id % 100 ELSE 50 END AS INT) AS overall_score,
  CASE event_id % 4 WHEN 2 THEN a ELSE '' END AS raw_response
  FROM (SELECT *, {ANSWER} AS a FROM events)"""


def e16(spark, sf):
    return b22(spark, sf).groupBy("overall_score").agg(
        F.sum("issues_found").alias("issues"), F.count(F.lit(1)).alias("n")
    )


E16_SQL = f"""SELECT overall_score, CAST(sum(issues_found) AS BIGINT) AS issues, count(*) AS n
  FROM ({B22_SQL}) GROUP BY 1"""

STOPS = ["\n\n", "\ndef ", ". "]


def b23(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.apply_stops(F.col("text"), STOPS).alias("text")
    )


_CUT = "text"
for _stop in STOPS:
    _CUT = f"string_split({_CUT}, {sql_text(_stop)})[1]"
B23_SQL = f"SELECT doc_id, {_CUT} AS text FROM documents"


def b24(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length(X.embedding_text(F.col("text"))).alias("n")
    )


B24_SQL = "SELECT doc_id, length(left(text, 5000)) AS n FROM documents"


def b25(spark, sf):
    ends = F.col("l_shipdate").cast("timestamp")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return table(spark, sf, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy("l_orderkey").agg(
        F.max(X.elapsed_ms(F.col("o_orderdate"), ends)).alias("elapsed_ms")
    )


B25_SQL = """SELECT l_orderkey, max(date_diff('millisecond', o_orderdate, l_shipdate)) AS elapsed_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"""


def b26(spark, sf):
    k = F.get_json_object("props", "$.k")
    user = F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string"))
    forwarded = F.when(
        F.col("event_type") == "view", F.concat(F.lit(" 10.0.0."), k, F.lit(" , 10.1.1.1"))
    )
    host = F.when(F.col("event_type") != "error", F.concat(F.lit("h"), k))
    return table(spark, sf, "events").select(
        "event_id", X.client_key(user, forwarded, host).alias("client")
    )


B26_SQL = """SELECT event_id, CASE event_type WHEN 'purchase' THEN concat('user:', user_id)
  WHEN 'view' THEN concat('ip:10.0.0.', json_extract_string(props, '$.k'))
  WHEN 'error' THEN 'ip:unknown' ELSE concat('ip:h', json_extract_string(props, '$.k')) END AS client
  FROM events"""


def b30(spark, sf):
    return corpus.adjacent_turns(table(spark, sf, "conversations"), "conv_id").select(
        "conv_id", "turn", F.md5(F.concat("query", "response")).alias("hash")
    )


B30_SQL = f"WITH {PAIRS} SELECT conv_id, turn, md5(concat(query, response)) AS hash FROM pairs"


def b31(spark, sf):
    catalog = L.language_catalog(spark, "listing")
    files = code_files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    # The listing has twelve fixed rows.
    return files.join(F.broadcast(catalog), "language").select(
        "language", "title", F.array_join("extensions", " ").alias("extensions"), "files"
    )


_LISTED = ", ".join(f"('{i}', '{t}', '{' '.join(e)}')" for i, t, e in C.LISTED_LANGUAGES)
B31_SQL = with_files(f"""
SELECT c.language, c.title, c.extensions, count(*) AS files
FROM code_files f JOIN (VALUES {_LISTED}) c(language, title, extensions) USING (language)
GROUP BY ALL""")


def a1(spark, sf):
    path = F.col("path")
    return _paths(spark, sf).filter(~SRC.skipped(path)).filter(
        SRC.included(path, ["*.py", "*.js", "lib/*/f1?.*", "Dockerfile"])
    ).select("doc_id", "path")


A1_SQL = f"""WITH {PATHS} SELECT doc_id, path FROM paths
WHERE NOT list_bool_or(list_transform(string_split(path, '/'),
    lambda p: starts_with(p, '.') OR p IN ('node_modules', '__pycache__')))
  AND (path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%/Dockerfile'
    OR regexp_matches(path, '(^|/)lib/[^/]*/f1[^/][.][^/]*$'))"""


TREE_PATH = (f"concat(CASE doc_id % 9 WHEN 0 THEN 'node_modules/p' WHEN 1 THEN '.git/' "
             f"WHEN 2 THEN 'src/__pycache__/' ELSE 'src/' END, source, '/_f', {_ID}, "
             f"CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.txt' ELSE '' END)")


def _written_tree(spark, sf):
    """The documents as files in a folder of their own: some binary, some in skipped folders."""
    root = scratch_dir(spark, "tree")
    SRC.write_tree(table(spark, sf, "documents").select(
        F.expr(TREE_PATH).alias("path"),
        F.when(F.col("doc_id") % 11 == 5, F.concat(F.lit("\0"), F.coalesce("text", F.lit(""))))
        .otherwise(F.coalesce("text", F.lit(""))).alias("content")), root)
    return root


def a1_scan(spark, sf):
    """The files of a folder that path rules and a size filter choose, read back."""
    found = SRC.read_tree(spark, _written_tree(spark, sf), "r", ["*.py", "*.js", "src/*/_f1*"])
    return found.where("size_bytes > 300").select(
        "path", F.coalesce("language", F.lit("-")).alias("language"), "size_bytes",
        F.coalesce("hash", F.lit("-")).alias("hash"), F.coalesce("error", F.lit("-")).alias("error"))


_TREE = f"""tree AS (SELECT path, size_bytes, text,
    CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' ELSE '-' END
      AS language, CASE WHEN doc_id % 11 = 5 THEN 'binary file' ELSE '-' END AS error
  FROM (SELECT doc_id, coalesce(text, '') AS text, {TREE_PATH} AS path,
          strlen(coalesce(text, '')) + (doc_id % 11 = 5)::BIGINT AS size_bytes FROM documents))"""
A1_SCAN_SQL = f"""WITH {_TREE} SELECT path, language, size_bytes, error,
  CASE error WHEN '-' THEN md5(text) ELSE '-' END AS hash FROM tree
WHERE size_bytes > 300
  AND NOT regexp_matches(path, '(^|/)([.][^/]*|node_modules|__pycache__)/')
  AND (path LIKE '%.py' OR path LIKE '%.js' OR regexp_matches(path, '(^|/)src/[^/]*/_f1[^/]*$'))"""


def a2_scan(spark, sf):
    """Every file of a folder without rules, with errors as rows."""
    return SRC.read_tree(spark, _written_tree(spark, sf), "r", skip_rules=False).select(
        "path", F.coalesce("language", F.lit("-")).alias("language"), "size_bytes",
        F.coalesce("hash", F.lit("-")).alias("hash"), F.coalesce("error", F.lit("-")).alias("error"))


A2_SCAN_SQL = f"""WITH {_TREE} SELECT path, language, size_bytes, error,
  CASE error WHEN '-' THEN md5(text) ELSE '-' END AS hash FROM tree"""


def a3(spark, sf):
    """Bytes with a broken one in the middle decode to the text without it."""
    broken = F.unhex(F.concat(F.hex(F.encode("text", "UTF-8")), F.lit("FF41")))
    decoded = SRC.decode_text(broken)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(decoded).alias("hash"), F.length(decoded).alias("n")
    )


A3_SQL = "SELECT doc_id, md5(concat(text, 'A')) AS hash, length(text) + 1 AS n FROM documents"


def a4(spark, sf):
    """A NUL after the text is only seen when it is among the first 1024 bytes."""
    with_nul = F.unhex(F.concat(F.hex(F.encode("text", "UTF-8")), F.lit("00")))
    return table(spark, sf, "documents").select(
        "doc_id", SRC.is_binary(with_nul).cast("int").alias("is_binary")
    )


A4_SQL = """SELECT doc_id, CASE WHEN octet_length(encode(text)) < 1024 THEN 1 ELSE 0 END AS is_binary
  FROM documents"""


def a5(spark, sf):
    return SRC.cap_files(code_files(spark, sf), max_bytes=4000, max_files=50).select(
        "file_id", "repo_id", "path"
    )


A5_SQL = with_files("""
SELECT file_id, repo_id, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path)
    AS rn FROM code_files WHERE octet_length(encode(content)) <= 4000 AND language IS NOT NULL)
WHERE rn <= 50""")


QUERIES = {
    "a1_path_rules": (a1, A1_SQL),
    "a1_scan_directory": (a1_scan, A1_SCAN_SQL),
    "a2_scan_unfiltered": (a2_scan, A2_SCAN_SQL),
    "a3_decode_text": (a3, A3_SQL),
    "a4_binary_detection": (a4, A4_SQL),
    "a5_file_caps": (a5, A5_SQL),
    "b1_detect_language": (_language("scanner"), _language_sql(C.SCANNER_LANGUAGES, False)),
    "b2_detect_language_extended": (
        _language("extended"), _language_sql(C.EXTENDED_LANGUAGES, True)),
    "b3_primary_extension": (b3, B3_SQL),
    "b4_content_hash": (b4, "SELECT doc_id, md5(text) AS hash FROM documents"),
    "b5_normalize_code": (b5, B5_SQL),
    "b6_extract_imports": (b6, B6_SQL),
    "b7_count_lines": (b7, B7_SQL),
    "b8_truncate_code": (b8, B8_SQL),
    "b9_sanitize_filename": (b9, B9_SQL),
    "b10_parse_git_url": (b10, B10_SQL),
    "b11_mime_type": (b11, B11_SQL),
    "b12_repo_name": (b12, B12_SQL),
    "b13_stable_ids": (b13, B13_SQL),
    "b14_snippet": (b14, B14_SQL),
    "b15_external_severity": (b15, B15_SQL),
    "b16_severity_rank": (b16, B16_SQL),
    "b18_format_chat": (b18, B18_SQL),
    "b19_format_instruction": (b19, B19_SQL),
    "b20_format_dispatch": (b20, B20_SQL),
    "b21_prompts": (b21, B21_SQL),
    "b22_parse_output": (b22, B22_SQL),
    "b23_stop_sequences": (b23, B23_SQL),
    "b24_embedding_text": (b24, B24_SQL),
    "b25_elapsed_ms": (b25, B25_SQL),
    "b26_client_key": (b26, B26_SQL),
    "b30_query_response": (b30, B30_SQL),
    "b31_language_listing": (b31, B31_SQL),
    "e16_output_scores": (e16, E16_SQL),
}
