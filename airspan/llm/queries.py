"""The operators applied to their whole tables, by name, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.llm import classlm, toxicity
from airspan.llm.alignment import cross_tokenizer
from airspan.llm.decontam import contaminated
from airspan.llm.jaccard import similar_sets
from airspan.llm.langid import fit, predict
from airspan.llm.linededup import drop_boilerplate
from airspan.llm.neardup import near_duplicates
from airspan.llm.negatives import hard_negatives
from airspan.llm.packing import pack
from airspan.llm.passages import repeated_passages
from airspan.llm.quality import quality
from airspan.llm.secrets import ACCESS, ALLOWED, ASSIGN, CLASSES, HEX, KINDS, find_secrets, span_text
from airspan.llm.text import held_out
from airspan.llm.tokens import pieces

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[str, str]:
    """The files of the vocabulary that the queries use; the library that brings them is on every executor."""
    import public_tokenizers
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return register


def _runs_sql(pattern: str) -> str:
    """SQL for (start, end, hit) of the matches: what precedes a match, and the earlier matches."""
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(text, '{p}')) + 1), lambda i: {{
      's': coalesce(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))), 0)::INT
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i - 1], lambda x: length(x))), 0)::INT,
      'hit': regexp_extract_all(text, '{p}')[i]}})"""


# What the first pattern of the allow list stands for, without looking ahead.
WORDS = r"^[-+/_]*([A-Z]?[a-z]+|[A-Z]+)([-+/_]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[-+/_]*$"


def _secrets_sql() -> str:
    """Base spans, then every window of every candidate measured on its own, not by sliding."""
    base = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)]
    runs = " UNION ALL ".join(
        f"SELECT r, {i} AS k, unnest({_runs_sql(p)}) AS m FROM d" for i, (_, p) in enumerate(base))
    long = ASSIGN.replace("'", "''")
    ctes = [f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)""",
            f"""b AS (SELECT r, k, m.s AS s, m.s + length(m.hit) AS e FROM ({runs})
              WHERE k <> 0 OR length(regexp_extract(m.hit, '{long}', 2)) >= 12)"""]
    seen = "b"
    for i, c in enumerate(CLASSES):
        allowed = " OR ".join(f"regexp_matches(m.hit, '{p}')" for p in (WORDS, *ALLOWED[1:]))
        text = "lower(m.hit)" if c.fold else "m.hit"
        ctes.append(f"""c{i} AS (SELECT r, m.s AS s, {text} AS t FROM (
              SELECT r, unnest({_runs_sql(f"{c.pattern}{{{c.width},}}")}) AS m FROM d) WHERE NOT ({allowed}))""")
        ctes.append(f"""w{i} AS (SELECT r, s, unnest(range(0, length(t) - {c.width - 1})) AS o, t FROM c{i})""")
        ctes.append(f"""h{i} AS (SELECT r, s, o, sum({c.table}[n + 1]) AS z FROM (
              SELECT r, s, o, ch, count(*) AS n FROM (
                SELECT r, s, o, unnest(string_split(substr(t, o + 1, {c.width}), '')) AS ch FROM w{i}) GROUP BY ALL)
              GROUP BY ALL HAVING z <= {c.most})""")
        ctes.append(f"""g{i} AS (SELECT r, s, o, sum(new) OVER (PARTITION BY r, s ORDER BY o) AS g FROM (
              SELECT r, s, o, CASE WHEN o <= lag(o) OVER (PARTITION BY r, s ORDER BY o) + {c.width} THEN 0 ELSE 1 END AS new
              FROM h{i}))""")
        ctes.append(f"""e{i} AS (SELECT r, {KINDS.index(c.kind)} AS k, s + min(o) AS s, s + max(o) + {c.width} AS e
              FROM g{i} GROUP BY r, g{i}.s, g)""")
        ctes.append(f"""n{i} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM e{i} x WHERE NOT EXISTS (
              SELECT 1 FROM {seen} y WHERE y.r = x.r AND y.s <= x.s AND y.e >= x.e))""")
        seen = f"n{i}"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    join = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""WITH {", ".join(ctes)}
      SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex, sha256(coalesce({join} FILTER (k < 3), '')) AS base_sha256,
        coalesce({join}, '') AS spans
      FROM d LEFT JOIN {seen} USING (r) GROUP BY r, doc_id"""


@query("op1_secrets", _secrets_sql())
def op1_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    cut = pieces(table(spark, sf_dir, "documents"), **vocabulary(), with_ids=False)
    return pack(cut)


@query("op3_language")
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    aside = held_out(F.col("doc_id"), 3)
    model = fit(docs.filter(~aside & F.col("doc_id").isNotNull()))
    return predict(docs, model, "text", F.col("doc_id"), aside.alias("held_out"))


def _similar_sql(width: int, percent: int, columns: str) -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, {columns}
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = w.doc_id"""


@query("op4_near_duplicates", _similar_sql(4, 80, "m.c AS component_id, w.doc_id = m.c AS kept"))
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op5_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT r, pos, line, trim(regexp_replace(line, '[\\x09-\\x0D]', ' ', 'g'), ' ') AS key,
             ('0x' || md5(coalesce(source, ''))[1:15])::BIGINT AS site FROM l),
m AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 10 AND count(DISTINCT site) > 1),
t AS (SELECT text, key, min(site) AS site, ('0x' || md5(key)[1:15])::BIGINT AS h, key IN (SELECT key FROM m) AS common
      FROM k JOIN d USING (r) WHERE key <> '' GROUP BY text, key),
u AS (SELECT text, sum(length(key)) AS whole, sum(length(key)) FILTER (common) AS shared, min(site) AS site,
             list_sort(list(h) FILTER (common))[1:2] AS least FROM t GROUP BY text),
v AS (SELECT key, min(u.site) AS site FROM t JOIN u USING (text) WHERE common
      GROUP BY key, CASE WHEN 2 * (shared - length(key)) > whole - length(key)
                         THEN 'line ' || CASE WHEN h = least[1] THEN least[2] ELSE least[1] END ELSE 'text ' || text END),
s AS (SELECT key FROM v GROUP BY key HAVING count(DISTINCT site) >= 10),
h AS (SELECT r, count(*) AS c FROM k JOIN s USING (key) GROUP BY r),
j AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM s)) AS t
      FROM k GROUP BY r)
SELECT doc_id, CASE WHEN c > 0 THEN coalesce(t, '') ELSE text END AS text, coalesce(c, 0) AS n_removed
FROM d LEFT JOIN h USING (r) LEFT JOIN j USING (r)""")
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs, removed="n_removed").drop("source")


@query("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "p_good")


@query("op7_class_lm")
def op7_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classlm.score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 5).alias("aside")))


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnt = docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").filter(~held_out(F.col("doc_id"), 3))
    model = toxicity.fit(learnt.select("text", "label"))
    scored = toxicity.score(docs, model, "text", F.col("doc_id"), held_out(F.col("doc_id"), 3).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op10_passages")
def op10_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS s
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id,
    (row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b))::INT AS rank, b AS negative_id,
    ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
QUALIFY rank <= 3""")
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query("op12_jaccard_join", _similar_sql(3, 90, "m.c AS component_id"))
def op12_jaccard_join(spark, sf_dir):
    return similar_sets(table(spark, sf_dir, "documents"), width=3, percent=90)


@query("op13_cross_tokenizer")
def op13_cross_tokenizer(spark, sf_dir):
    import public_tokenizers
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return cross_tokenizer(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), **vocabulary(),
                           model=public_tokenizers.path("piece_bpe_32k.model"), more=(digest,))
