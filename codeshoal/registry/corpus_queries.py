"""Registered queries: corpus preparation, batch inference, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as CO
from ..operators import inference as I
from ..session import scratch_dir
from ..sources import corpora
from .base import code_files, table, with_files
from .text_queries import PAIRS


def _documents(spark, sf):
    return table(spark, sf, "documents")


def _take_sql(source: str, weight: float) -> str:
    return (
        f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id)"
        f" AS rn, count(*) OVER () AS n FROM documents WHERE {source})"
        f" WHERE rn <= CAST(floor(n * {weight}) AS BIGINT)"
    )


def s1(spark, sf):
    """Documents by language, weighted as a mix of three sources."""
    docs = _documents(spark, sf).select("doc_id", "lang", "n_chars")
    parts = [
        (docs.filter("lang = 'en'"), 0.4), (docs.filter("lang = 'de'"), 0.3),
        (docs.filter("lang NOT IN ('en', 'de')"), 1.0),
    ]
    return CO.weighted_mix(parts, "doc_id").select("doc_id", "lang", "n_chars")


S1_SQL = f"""SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (
  {_take_sql("lang = 'en'", 0.4)} UNION ALL {_take_sql("lang = 'de'", 0.3)}
  UNION ALL SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'de'))"""


def s2(spark, sf):
    """Order keys of the seeded shuffle."""
    shuffled = CO.shuffle(_documents(spark, sf).select("doc_id"), "doc_id")
    return shuffled.select("doc_id", CO.order_key(F.col("doc_id")).alias("position"))


def s3(spark, sf):
    return CO.train_test_split(_documents(spark, sf), "doc_id").select("doc_id", "split")


S3_SQL = """SELECT doc_id, CASE WHEN CAST(concat('0x', substr(md5(concat('42:', doc_id)), 1, 8)) AS BIGINT)
  % 1000 < 100 THEN 'test' ELSE 'train' END AS split FROM documents"""


def s4(spark, sf):
    return CO.cap_length(_documents(spark, sf), max_tokens=2048).select(
        "doc_id", "n_tokens", F.md5("text").alias("hash")
    )


S4_SQL = """SELECT doc_id, CAST(least(len(t), 2048) AS INT) AS n_tokens,
  md5(CASE WHEN len(t) > 2048 THEN array_to_string(t[1:2048], ' ') ELSE text END) AS hash
FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '') AS t
  FROM documents)"""


def s5(spark, sf):
    return CO.augment(
        _documents(spark, sf), "doc_id", synonyms={"the": "a", "der": "ein", "and": "or"}
    ).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("hash"))


def _draw(kind: str) -> str:
    return (
        f"CAST(concat('0x', substr(md5(concat('42:{kind}:', doc_id, ':', i - 1)), 1, 8)) AS BIGINT)"
        " % 1000 < 100"
    )


S5_SQL = f"""SELECT doc_id, length(text) AS n, md5(text) AS hash FROM (SELECT doc_id, array_to_string(
  list_filter(list_transform(string_split(text, ' '), lambda x, i:
    CASE WHEN {_draw('drop')} THEN NULL
      WHEN x IN ('the', 'der', 'and') AND {_draw('swap')}
        THEN CASE x WHEN 'the' THEN 'a' WHEN 'der' THEN 'ein' ELSE 'or' END
      ELSE x END), lambda x: x IS NOT NULL), ' ') AS text FROM documents)"""


def _responses(spark, sf):
    return _documents(spark, sf).select(
        F.concat("source", F.lit("/"), "lang").alias("prompt"),
        F.md5("text").alias("response"), F.col("n_chars").alias("score"),
    )


def s6(spark, sf):
    return CO.to_pairwise(_responses(spark, sf), "prompt", "response", "score")


S6_SQL = """SELECT prompt, chosen, rejected, chosen_score, rejected_score FROM (
  SELECT concat(source, '/', lang) AS prompt,
    arg_max(md5(text), (n_chars, md5(text))) AS chosen, arg_min(md5(text), (n_chars, md5(text))) AS rejected,
    max(n_chars) AS chosen_score, min(n_chars) AS rejected_score FROM documents GROUP BY 1)
WHERE chosen_score > rejected_score"""


def s6_pointwise(spark, sf):
    return CO.to_pointwise(s6(spark, sf), "prompt")


S6_POINTWISE_SQL = f"""SELECT prompt, chosen AS response, 1 AS label FROM ({S6_SQL})
UNION ALL SELECT prompt, rejected, 0 FROM ({S6_SQL})"""


def s7(spark, sf):
    grouped = CO.group_by_length(_documents(spark, sf), "text", "doc_id", partitions=8)
    return grouped.select("doc_id", CO.length_bucket(F.col("n_chars")).alias("bucket"))


def h2(spark, sf):
    docs = _documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang")
    tests = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return CO.concat_sources(docs, tests).groupBy(
        F.coalesce("lang", F.lit("-")).alias("lang")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


H2_SQL = """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT lang, text FROM documents UNION ALL SELECT '-', text FROM benchmark) GROUP BY lang"""

# --- sources: written to the shared folder, then read through the dispatcher ---------


def _round_trip(df, spark, name):
    path = scratch_dir(spark, "source") + "/" + name
    if name.endswith(".parquet"):
        df.write.parquet(path)
    else:
        df.write.json(path)
    return corpora.load_source(spark, path, schema=df.schema, on_missing="fail")


def a6(spark, sf):
    turns = table(spark, sf, "conversations")
    return _round_trip(turns, spark, "turns.jsonl").select(
        "conv_id", "turn", "role", F.md5("text").alias("hash")
    )


A6_SQL = "SELECT conv_id, turn, role, md5(text) AS hash FROM conversations"


def a7(spark, sf):
    """Counts per language as one JSON object of equally long columns."""
    counts = _documents(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    # One entry per language: a handful, whatever the number of documents.
    columns = counts.groupBy().agg(F.collect_list(F.struct("lang", "n", "chars")).alias("r"))
    path = scratch_dir(spark, "source") + "/counts.json"
    columns.select("r.lang", "r.n", "r.chars").write.json(path)
    return corpora.load_source(spark, path, on_missing="fail").select("lang", "n", "chars")


A7_SQL = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"


def a8(spark, sf):
    return corpora.load_source(spark, f"{sf}/documents.parquet").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


A8_SQL = A7_SQL


def a9(spark, sf):
    """A mix over paths of which one is missing and skipped."""
    mix = corpora.load_mix(
        spark,
        [{"path": f"{sf}/documents.parquet", "weight": 0.25}, {"path": f"{sf}/missing.jsonl"}],
        "doc_id",
    )
    return mix.select("doc_id", "lang")


A9_SQL = f"""SELECT doc_id, lang FROM documents WHERE doc_id IN ({_take_sql('true', 0.25)})"""

# --- inference -------------------------------------------------------------------


def _echo(name: str):
    if name == "absent":
        raise RuntimeError("no such model")

    def model(texts):
        if any(t.startswith("T") for t in texts):
            raise ValueError("bad input")
        return [f"{t}!" for t in texts]
    return model


def k4(spark, sf):
    prompts = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("prompt"),
        F.when(F.col("item_id") % 3 == 0, "absent").when(F.col("item_id") % 3 == 1, "big")
        .alias("model"),
    )
    return I.generate(prompts, _echo).select(
        "id", F.coalesce(F.md5("text"), F.lit("-")).alias("hash"), "model_used",
        F.coalesce("error", F.lit("-")).alias("error"),
    )


K4_SQL = """SELECT item_id AS id, CASE WHEN starts_with(text, 'T') THEN '-' ELSE md5(concat(text, '!')) END AS hash,
  CASE WHEN item_id % 3 = 1 THEN 'big' ELSE 'default' END AS model_used,
  CASE WHEN starts_with(text, 'T') THEN 'bad input' ELSE '-' END AS error FROM benchmark"""


def _letters():
    def encode(texts):
        return [[float(len(t)), float(t.count("a")), float(t.count("\n"))] for t in texts]
    return encode


def k3(spark, sf):
    texts = _documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    vectors = I.embed(texts, _letters)
    return vectors.select("id", *[
        F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(3)
    ])


K3_SQL = """SELECT doc_id AS id, CAST(length(t) AS DOUBLE) AS x0,
  CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS x1,
  CAST(length(t) - length(replace(t, chr(10), '')) AS DOUBLE) AS x2
FROM (SELECT doc_id, text AS t FROM documents)"""


def _lengths():
    return lambda texts: [len(t) / 10 for t in texts]


def k5(spark, sf):
    pairs = CO.adjacent_turns(table(spark, sf, "conversations"), "conv_id")
    return I.score(pairs, _lengths, "conv_id", "turn").select(
        "conv_id", "turn", F.round("reward", 6).alias("reward")
    )


K5_SQL = f"""WITH {PAIRS} SELECT conv_id, turn, round(length(concat(query, response)) / 10.0, 6) AS reward
FROM pairs"""


def _todo(code, language):
    return [
        {"finding_type": "quality", "rule_id": "LONG", "rule_name": "Long line", "severity": "info",
         "message": language or "", "line_start": n, "line_end": n}
        for n, line in enumerate(code.split("\n"), 1) if len(line) > 400
    ]


def k2(spark, sf):
    snippets = code_files(spark, sf).select(
        F.col("file_id").alias("id"), F.col("content").alias("code"),
        F.coalesce("language", F.lit("")).alias("language"),
    )
    return I.run_analyzer(snippets, _todo).select("id", "rule_id", "message", "line_start")


K2_SQL = with_files("""SELECT file_id AS id, 'LONG' AS rule_id, coalesce(language, '') AS message,
  CAST(line_no AS INT) AS line_start FROM lines WHERE length(line) > 400""", lines=True)


def k1(spark, sf):
    """A user rule table with a broken pattern: findings and rejects together."""
    from ..operators import rules as R

    user = spark.createDataFrame(
        [
            ("U1", "Return", r"return\s+\w+", "low", "low", "m", "s", None, ["python"], True),
            ("U2", "Broken", r"(unclosed", "low", "low", "m", "s", None, ["*"], True),
            ("U3", "Off", r"def", "low", "low", "m", "s", None, ["*"], False),
            ("U4", "Any", r"import", "low", "low", "m", "s", None, ["*"], True),
        ],
        R.RULE_SCHEMA,
    )
    good, bad = R.validate_rules(user)
    found = R.security_scan(code_files(spark, sf), good)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).unionByName(
        bad.select("rule_id", F.lit(-1).cast("bigint").alias("n"))
    )


def k1_many(spark, sf):
    """A thousand user rules: names that end in one number each, followed by a bracket."""
    from ..operators import rules as R

    user = spark.createDataFrame(
        [(f"N{i}", f"number {i}", rf"[a-z]{i}\(", "low", "low", "m", "s", None, ["*"], True)
         for i in range(10, 1010)],
        R.RULE_SCHEMA,
    )
    good, _ = R.validate_rules(user)
    return R.security_scan(code_files(spark, sf), good).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"))


K1_MANY_SQL = with_files("""SELECT concat('N', number) AS rule_id, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(line, '[A-Za-z]([0-9]+)\\(', 1)) AS number FROM lines
  WHERE language IS NOT NULL)
WHERE number IN (SELECT CAST(range AS VARCHAR) FROM range(10, 1010)) GROUP BY number""", lines=True)


K1_SQL = with_files("""SELECT 'U1' AS rule_id,
  CAST(sum(len(regexp_extract_all(line, '(?i)return\\s+\\w+'))) AS BIGINT) AS n
  FROM lines WHERE language = 'python'
UNION ALL SELECT 'U4', CAST(sum(len(regexp_extract_all(line, '(?i)import'))) AS BIGINT) FROM lines
  WHERE language IS NOT NULL
UNION ALL SELECT 'U2', -1""", lines=True)

QUERIES = {
    "s1_weighted_mix": (s1, S1_SQL),
    "s2_seeded_shuffle": (
        s2, "SELECT doc_id, md5(concat('42:', doc_id)) AS position FROM documents"),
    "s3_train_test_split": (s3, S3_SQL),
    "s4_length_cap": (s4, S4_SQL),
    "s5_augmentation": (s5, S5_SQL),
    "s6_preference_pairs": (s6, S6_SQL),
    "s6_preference_points": (s6_pointwise, S6_POINTWISE_SQL),
    "s7_length_groups": (
        s7, "SELECT doc_id, CAST(length(text) // 256 AS BIGINT) AS bucket FROM documents"),
    "h2_concat_sources": (h2, H2_SQL),
    "a6_jsonl_source": (a6, A6_SQL),
    "a7_json_columns_source": (a7, A7_SQL),
    "a8_parquet_source": (a8, A8_SQL),
    "a9_source_dispatch": (a9, A9_SQL),
    "k1_user_rules": (k1, K1_SQL),
    "k1_many_rules": (k1_many, K1_MANY_SQL),
    "k2_analyzer_plugin": (k2, K2_SQL),
    "k3_batch_embedding": (k3, K3_SQL),
    "k4_batch_generation": (k4, K4_SQL),
    "k5_reward_scoring": (k5, K5_SQL),
}
