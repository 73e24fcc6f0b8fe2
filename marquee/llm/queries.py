"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, collocations, html_paths, langid, near_dup, ogg, packing, resample, sharding, simhash, toxicity, weak_rules
from ._common import hash_share, map_text, mapped_table, materialise, send_table, table

SHARDS = 8
#: Most labels that are broadcast to find their texts, and most that are sent to every executor as files (12 bytes each) and mapped there.
MOST_LABELS_SENT, MOST_LABELS_MAPPED = 500_000, 50_000_000


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = sharding.assign_shards(docs, ["doc_id", "text_crc32", "size"], SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.store_media(table(spark, sf_dir, "documents")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model, extra=[held.alias("held_out")])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest_ids(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of about `most` labelled documents at most, drawn by a hash of the id.

    The labels are drawn before the join, so what is broadcast is bounded by `most` and no text is shuffled.
    """
    marks = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("_marked"), label)
    drawn = marks.where(hash_share(F.col("_marked")) < min(1.0, most / max(1, marks.count())))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_marked")).select("doc_id", "text", label)


def all_labelled(docs: DataFrame, labels: DataFrame, label: str, most_sent: int | None = None, most_mapped: int | None = None) -> DataFrame:
    """(doc_id, text, label) of every labelled document. Up to most_sent labels are broadcast and up to most_mapped looked up in files, so no text is shuffled; more are joined by a shuffle."""
    most_sent, most_mapped = (MOST_LABELS_SENT if most_sent is None else most_sent), (MOST_LABELS_MAPPED if most_mapped is None else most_mapped)
    marks = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("_marked"), label)
    n = marks.count()
    if most_sent < n <= most_mapped and dict(docs.dtypes)["doc_id"] == dict(marks.dtypes)["_marked"] == "bigint":
        return looked_up(docs, marks, label, n)
    marks = F.broadcast(marks) if n <= most_sent else marks
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_marked")).select("doc_id", "text", label)


def looked_up(docs: DataFrame, marks: DataFrame, label: str, n: int) -> DataFrame:
    """The join of docs with n marks (_marked, label) by their long ids, in one pass over docs; xxhash64 of one long gives no two ids the same key."""
    known = marks.where("_marked IS NOT NULL").select(F.xxhash64("_marked").alias("key"), F.col(label).cast("int").alias("value"))
    sent = send_table(known, n, "int32")

    def find(batch: pa.RecordBatch, state):
        keys, values = mapped_table(sent)
        asked = batch.column(1).to_numpy()
        first = np.searchsorted(keys, asked, "left")
        times = np.searchsorted(keys, asked, "right") - first
        rows = np.repeat(np.arange(len(asked)), times)
        if not len(rows):
            return None
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        return [*(batch.column(c).take(pa.array(rows)) for c in (0, 2)), pa.array(values[np.repeat(first, times) + nth])]

    own = docs.where("doc_id IS NOT NULL")
    return map_text(own, [F.col("doc_id"), F.xxhash64("doc_id").alias("key"), F.col("text")], find, f"doc_id long, text string, {label} int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out()
    model = toxicity.fit(all_labelled(docs, table(spark, sf_dir, "labels").where(~held), "toxic"))
    return toxicity.score(docs, model).withColumn("held_out", held)


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(materialise(weak_rules.measure(table(spark, sf_dir, "documents")), "measures"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "posterior")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = byte_cnn.held_out()
    model = byte_cnn.fit(labelled(docs, table(spark, sf_dir, "labels").where(~held), "quality", byte_cnn.MAX_TRAIN_DOCS))
    return byte_cnn.score(docs, model, extra=[held.alias("held_out")])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sharding, op2_ogg, op3_langid, op4_packing, op5_bpe, op6_html, op7_near_dup, op8_toxicity, op9_weak_rules, op10_byte_cnn, op11_collocations, op12_simhash, op13_resample, pipeline]
    return {f.__name__: f for f in own}


#: op7 on full sets: pairs that share one of their rarest shingles (two sets at 0.8 must), an exact count of what they share, and reachability.
NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
rare AS (SELECT s, count(*) AS df FROM shingles GROUP BY 1),
ranked AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM shingles JOIN rare USING (s) JOIN sizes USING (doc_id)),
prefix AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
near AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM near JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS c FROM both_ways UNION SELECT both_ways.b, reach.c FROM reach JOIN both_ways ON both_ways.a = reach.doc_id),
least_of AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(coalesce(c, documents.doc_id), documents.doc_id) AS component_id, coalesce(c, documents.doc_id) >= documents.doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


#: op11: all runs of 2 to 4 words of each piece counted, cuts by joins, containment by position lists.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
runs AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 30),
split AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM split, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, j, (2000000::HUGEINT * cuts.f // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM split, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
longer AS (SELECT lang, phrase, max(f) AS most FROM parts GROUP BY 1, 2),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

#: op13: crc32 by its table, computed here too; the draw by one global order.
RESAMPLE_SQL = r"""
WITH crc AS (SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
words AS (
  SELECT doc_id, true AS own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT item_id, false, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
terms AS (SELECT doc_id, own, unnest(w) AS term FROM words),
hexed AS (SELECT DISTINCT term, hex(encode(term)) AS h FROM terms),
hashed AS (
  SELECT term, xor(list_reduce([4294967295] || [('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(h) // 2 + 1)], lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc),
counted AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM terms JOIN hashed USING (term) GROUP BY 1),
sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM counted),
gains AS (SELECT bucket, floor(1000 * ln(((counted.t + 1) * (sums.s + 10000))::DOUBLE / ((counted.s + 1) * (sums.t + 10000))::DOUBLE))::BIGINT AS gain FROM counted, sums),
means AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM terms JOIN hashed USING (term) JOIN gains USING (bucket) WHERE own GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN means USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, place AS rank FROM scored LEFT JOIN (SELECT * FROM placed WHERE place <= most) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express on whole tables. It cannot run the other methods' checksums, permutation, tokenizers or trained models; brute-force tests stand in for it."""
    return {"op7_near_dup": NEAR_DUP_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_resample": RESAMPLE_SQL}
