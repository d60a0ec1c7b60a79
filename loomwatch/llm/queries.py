"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.llm import ann, bpe, decontaminate, fuzzy_hash, html_extract, line_dedup, merkle, minhash, secret_scan, sharding, toxicity, url_filter, vector_codes

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_total", "lines_dropped", "text")


def tokenizer() -> tuple[str, str]:
    """The rank file of the production vocabulary, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer()
    ids = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern)
    return bpe_digests(bpe.decode_ids(ids.drop("text"), vocabulary))


def bpe_digests(coded: DataFrame) -> DataFrame:
    written = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.extract_text(pages, html_extract.fit_labeller(pages), text_col="text")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")

    def written(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secret_scan.KINDS]
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def fold_of(doc_id) -> object:
    """The fold of a document: fold 1 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(docs, table(spark, sf_dir, "labels"), fold_of("doc_id") != 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_texts(docs, toxicity_model(spark, docs, sf_dir), score_col="score")
    held = F.coalesce(fold_of("doc_id") == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tamper=seventh, changed={"n_chars": F.col("n_chars") + 1})


def op13_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_hash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_html": op5_html,
    "op6_minhash": op6_minhash,
    "op7_secrets": op7_secrets,
    "op8_ann": op8_ann,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_fuzzy_hash": op13_fuzzy_hash,
}

#: Near lines by equal halves instead of deletion variants: an independent form of the same relation.
LINE_DEDUP_SQL = """
WITH e AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents WHERE text <> ''),
l AS (SELECT doc_id, no, raw, trim(raw) AS t, doc_id::HUGEINT * 1000000 + no AS o FROM e),
d AS (SELECT t, min(o) AS o, length(t) AS n FROM l WHERE length(t) >= 20 GROUP BY t),
k AS (SELECT t, o, n, n AS m FROM d UNION ALL SELECT t, o, n, n - 1 FROM d),
h AS (SELECT *, 'a' || left(t, m // 2) AS k FROM k UNION ALL SELECT *, 'z' || right(t, m - m // 2) FROM k),
p AS (
  SELECT DISTINCT a.t AS a, a.o AS ao, b.t AS b, b.o AS bo
  FROM h a JOIN h b ON a.m = b.m AND a.k = b.k
  WHERE a.n = a.m AND a.t <> b.t AND levenshtein(a.t, b.t) <= 1),
near AS (SELECT CASE WHEN ao > bo THEN a ELSE b END AS t FROM p GROUP BY ALL),
j AS (
  SELECT l.doc_id, l.no, l.raw,
         coalesce(d.o < l.o, false) OR near.t IS NOT NULL AS gone
  FROM l LEFT JOIN d ON d.t = l.t LEFT JOIN near ON near.t = l.t)
SELECT x.doc_id, coalesce(max(j.no) + 1, 0)::BIGINT AS lines_total,
       count(*) FILTER (WHERE j.gone)::BIGINT AS lines_dropped,
       coalesce(string_agg(j.raw, chr(10) ORDER BY j.no) FILTER (WHERE NOT j.gone), '') AS text
FROM documents x LEFT JOIN j ON j.doc_id = x.doc_id GROUP BY x.doc_id
"""

DECONTAMINATE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM pos JOIN win USING (n, k)),
cov AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.c, 0)::BIGINT AS n_hit, coalesce(it.c, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, cov.c IS NOT NULL AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Rounds of assignment and update, unrolled; equal ids are not told apart."""
    def nearest(book: str, name: str) -> str:
        distance = "list_sum(list_transform(range(1, len(pt.c) + 1), lambda i: (pt.c[i] - b.c[i]) * (pt.c[i] - b.c[i])))"
        return f"{name} AS MATERIALIZED (SELECT vec_id, label, p, any_value(c) AS c, min({{'d': d, 'e': e}}) AS m FROM (SELECT pt.vec_id, pt.label, pt.p, pt.c, b.e, {distance} AS d FROM pt JOIN {book} b USING (p)) GROUP BY vec_id, label, p)"

    steps = []
    for r in range(rounds):
        steps.append(nearest(f"b{r}", f"a{r}"))
        steps.append(f"""u{r} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, floor(sum(c[i]) / count(*))::BIGINT AS x FROM a{r}, range(1, (SELECT max(len(c)) FROM pt) + 1) t(i) GROUP BY p, m.e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u USING (p, e))""")
    steps.append(nearest(f"b{rounds}", "z"))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pt AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS c FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM pt) WHERE e < {entries}),
{", ".join(steps)},
x AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM x
"""


def _merkle_sql(rows: int = 20, groups: int = 8) -> str:
    """Levels of both trees, unrolled: as many as 2^``rows`` leaves a group and 2^``groups`` groups need."""
    def level(name: str, k: int) -> str:
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, CASE WHEN t = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (t + 1) // 2 AS t FROM {name}{k} GROUP BY g, i // 2, t)"""

    def fold(name: str, k: int, old: str, new: str) -> str:
        return f"""{new} AS MATERIALIZED (SELECT f.* REPLACE (f.j // 2 AS j, f.proof || coalesce(s.h, '') AS proof,
  CASE WHEN o.t = 1 THEN v WHEN f.j % 2 = 0 THEN sha256(v || coalesce(s.h, '')) ELSE sha256(s.h || v) END AS v)
  FROM {old} f JOIN {name}{k} o ON o.g = f.g AND o.i = f.j LEFT JOIN {name}{k} s ON s.g = f.g AND s.i = xor(f.j, 1::BIGINT))"""

    def field(x: str) -> str:
        return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x}), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    table = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT))"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    steps = [level("n", k) for k in range(rows)]
    steps.append(f"m0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS t, g AS name FROM n{rows})")
    steps += [level("m", k) for k in range(groups)]
    steps.append("f0 AS MATERIALIZED (SELECT l.doc_id, l.g, n0.i AS j, l.leaf, CASE WHEN coalesce(c % 7 = 0, false) THEN l.other ELSE l.leaf END AS v, '' AS proof, l.no FROM l JOIN n0 ON n0.no = l.no)")
    steps += [fold("n", k, f"f{k}", f"f{k + 1}") for k in range(rows)]
    steps.append(f"p0 AS MATERIALIZED (SELECT f.* REPLACE ('' AS g, m0.i AS j), m0.h AS subroot FROM f{rows} f JOIN m0 ON m0.name = f.g)")
    steps += [fold("m", k, f"p{k}", f"p{k + 1}") for k in range(groups)]
    return f"""
WITH tb AS MATERIALIZED (SELECT {table} AS tab),
l AS MATERIALIZED (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS other, {crc} AS c, row_number() OVER () AS no FROM documents, tb),
n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS t, no FROM l),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified FROM p{groups}, (SELECT h AS root FROM m{groups})
"""


ORACLES: dict[str, str] = {"op11_vector_codes": _codes_sql(), "op12_merkle": _merkle_sql(), "op1_line_dedup": LINE_DEDUP_SQL, "op3_decontaminate": DECONTAMINATE_SQL}
