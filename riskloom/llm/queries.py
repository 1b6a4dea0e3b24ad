"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunking, decontaminate, divergence, embeddings, html, langid, minhash, packing, parsing, pii, resample, sharding
from .common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=packing.near_clusters(docs))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(k: int):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    count = [of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def size(spans: str):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])

    def said(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", F.size("shared").cast("long").alias("n_shared"), size("shared").alias("shared_bytes"), said("shared").alias("shared_spans"), F.size("removed").cast("long").alias("n_removed"), size("removed").alias("removed_bytes"), said("removed").alias("removed_spans"))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_main_text, op3_decontaminate, op4_best_fit, op5_pii, op6_near_vectors, op7_substring_dedup, op8_role_repair, op9_near_duplicates, op10_language, op11_source_divergence, op12_repeated_bytes, op13_target_resampling)}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS3 = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS9 = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"
_REACH = "r(node, other) AS (SELECT {0}, {0} FROM {1} UNION SELECT r.node, l.b FROM r JOIN links l ON l.a = r.other)"

#: What the results are in SQL, by comparing everything.
ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS3} AS w FROM documents), i AS (SELECT item_id, {_WORDS3} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
  its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar))) AS s FROM h GROUP BY 1)
  SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op6_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9), {_REACH.format('vec_id', 'v')},
  c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
  SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id""",
    "op9_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + k - 1], ' ') AS x FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), {_REACH.format('doc_id', 'd')},
  c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
  k AS (SELECT lang, term, cast(sum(n) AS hugeint) AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 10),
  l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
  s AS (SELECT lang, source, cast(sum(c.n) AS hugeint) AS total FROM c JOIN k USING (lang, term) GROUP BY 1, 2),
  p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p, 1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
  every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 10""",
    "op13_target_resampling": f"""WITH byte AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS3} AS w FROM documents), b AS (SELECT {_WORDS3} AS w FROM benchmark),
  word AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT unnest(w) FROM b)),
  bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS b FROM word, byte),
  dw AS (SELECT r, b FROM (SELECT r, unnest(w) AS word FROM d) JOIN bucket USING (word)), s AS (SELECT b, count(*) AS s FROM dw GROUP BY 1),
  t AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN bucket USING (word) GROUP BY 1),
  gain AS (SELECT s.b, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT sum(s) FROM s) + 10000)::double / ((s + 1)::double * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::double))) AS bigint) AS g FROM s LEFT JOIN t ON s.b = t.b),
  weight AS (SELECT r, cast(floor(sum(g) / count(*)) AS bigint) AS weight FROM dw JOIN gain USING (b) GROUP BY 1),
  scored AS (SELECT d.r, doc_id, cast(len(w) AS bigint) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS varchar), '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM d LEFT JOIN weight ON weight.r = d.r),
  drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn ON drawn.r = scored.r""",
}
