"""The pN_ queries over the test tables, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, copies, groups, neighbours, overlap, packing, subjects, terms, vectors
from . import common as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["anchor", "positive", "negative", "split", "author_id", "source"]
    return C.once(C.table(spark, sf_dir, "triplets"), "triplet_id", cols)


# 3: splits that keep related records together


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    return groups.related_groups(t.select(F.col("triplet_id").alias("id"), F.col("author_id").alias("author"), "anchor", "source"), ("source",))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select(F.col("id").alias("triplet_id"), "group_id")


@query
def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.split_rows(C.cut(_grouped(spark, sf_dir)), "source").select(F.col("id").alias("triplet_id"), "split")


@query
def p3_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every assignment must keep: a split for each row, no unit in two splits, shares within half a per cent or the
    greatest unit's share."""
    rows = C.cut(groups.split_rows(C.cut(_grouped(spark, sf_dir)), "source").select("id", "unit", "split"))
    units = rows.groupBy("unit").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"))
    broken, most = units.agg(F.sum((F.col("splits") > 1).cast("bigint")), F.max("n")).first()
    n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # three rows
    total = max(1, sum(n.values()))
    fine = all(abs(n.get(s, 0) / total - p) <= max(0.005, (most or 0) / total) for s, p in groups.SHARES.items())
    return spark.createDataFrame([(sum(n.values()), broken or 0, fine)], "n_rows bigint, broken bigint, shares_kept boolean")


SQL["p3_properties"] = "SELECT count(DISTINCT triplet_id) AS n_rows, 0::BIGINT AS broken, true AS shares_kept FROM triplets"


@query
def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and source, with the split's share of all rows and of the source's."""
    rows = groups.split_rows(C.cut(_grouped(spark, sf_dir)), "source")
    per = rows.groupBy("split", "source").agg(F.count("*").alias("n_rows"))
    whole = F.sum("n_rows").over(groups.Window.partitionBy("source"))
    return per.select("split", "source", "n_rows", F.round(F.col("n_rows") / whole, 6).alias("share_of_source"))


# 4: duplicates hidden by formatting differences


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = C.once(C.table(spark, sf_dir, "sentences"), "sentence_id", ["anchor"])
    r = C.once(C.table(spark, sf_dir, "samples"), "sample_id", ["review"])
    return (
        s.select(F.lit("sentence").alias("kind"), F.col("sentence_id").alias("id"), F.col("anchor").alias("text")),
        r.select(F.lit("sample").alias("kind"), F.col("sample_id").alias("id"), F.col("review").alias("text")),
    )


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = _texts(spark, sf_dir)
    return copies.copy_pairs(s).unionByName(copies.copy_pairs(r, sheets=True))


@query
def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = _texts(spark, sf_dir)
    return copies.collapse(s).unionByName(copies.collapse(r, sheets=True))


_KEYED = r"""
WITH raw AS (
  SELECT 'sentence' AS kind, sentence_id AS id, max_by(anchor, loaded_at) AS text FROM sentences GROUP BY sentence_id
  UNION ALL
  SELECT 'sample', sample_id, max_by(review, loaded_at) FROM samples GROUP BY sample_id
), plain AS (
  SELECT kind, id, regexp_replace(text, '<[^>]*>|&([A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);', ' ', 'g') AS t FROM raw WHERE text IS NOT NULL
), parts AS (
  SELECT kind, id, lower(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) AS k,
    list_filter(regexp_split_to_array(t, '[|;\n\r]+'), lambda s: regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g') <> '') AS segs FROM plain
), keyed AS (
  SELECT kind, id, CASE WHEN kind = 'sample' AND len(segs) >= 2
    AND len(list_filter(segs, lambda s: regexp_matches(s, '(?i)^\s*(story|acting|pacing|sound|ending|verdict)\s*:'))) = len(segs)
    THEN 's:' || array_to_string(list_sort(list_transform(segs, lambda s: lower(regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g')))), '|')
    ELSE 't:' || k END AS key FROM parts WHERE k <> ''
), firsts AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, key) AS first_id FROM keyed)
"""
SQL["p4_found"] = _KEYED + "SELECT kind, first_id, id AS copy_id FROM firsts WHERE id <> first_id"
SQL["p4_records"] = _KEYED + "SELECT kind, first_id, count(*) AS copies FROM firsts GROUP BY kind, first_id"


# 6: frequency of every term


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "tokenizer"), "corpus_v2")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("term", "mark")


@query
def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


_TERMS = """
WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) BETWEEN 2 AND 20), lambda w: lower(w)) AS w
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(w) AS term FROM d),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM t GROUP BY term),
l AS (SELECT max(min_df) AS lo, min(max_df) AS hi FROM tokenizer WHERE name = 'corpus_v2'),
m AS (SELECT term, occurrences, docs, CASE WHEN docs / n < lo THEN 'rare' WHEN docs / n > hi THEN 'common' END AS mark
  FROM c, l, (SELECT count(*)::DOUBLE AS n FROM d))
"""
SQL["p6_found"] = _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL"
SQL["p6_terms"] = _TERMS + "SELECT term, occurrences, docs, mark FROM m"


# 7: encoding with a public tokenizer


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(C.table(spark, sf_dir, "documents"))


@query
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded again, with whether it came back as it was."""
    docs = C.table(spark, sf_dir, "documents")
    back = bpe.decode(bpe.encode(docs)).withColumnRenamed("text", "decoded")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", F.length("decoded").cast("bigint").alias("n_chars"), same.alias("same"))


SQL["p7_round_trip"] = "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, true AS same FROM documents"


# 8: containers of fixed capacity


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.token_counts(C.table(spark, sf_dir, "documents")))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of all space that is used: with batches of one bucket each, and with room lent to others."""
    sizes = C.cut(bpe.token_counts(C.table(spark, sf_dir, "documents")))
    out = None
    for lend in (False, True):
        packed = packing.pack(sizes, lend=lend).where("container_id is not null")
        each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
        row = each.agg(F.lit(lend).alias("lent"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * 2048), 6).alias("fill"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def p8_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep: each document once and whole, no container over 2,048, places and starts without gaps."""
    sizes = C.cut(bpe.token_counts(C.table(spark, sf_dir, "documents")))
    packed = C.cut(packing.pack(sizes))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    cut_up = whole.join(sizes.select("doc_id", F.col("n_tokens").alias("due")), "doc_id").agg(
        F.count("*").alias("n_docs"), F.sum((F.col("n") != F.col("due")).cast("bigint")).alias("not_whole"), F.sum((F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("due") / 2048))).cast("bigint")).alias("needless_cuts"))
    full = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"), F.max("place").alias("last"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    bad = full.agg(F.sum((F.col("used") > 2048).cast("bigint")).alias("overfull"), F.sum(((F.col("last") + 1 != F.col("n")) | (F.col("end") != F.col("used"))).cast("bigint")).alias("gaps"))
    return cut_up.crossJoin(bad)  # of one row each


SQL["p8_properties"] = "SELECT count(*) AS n_docs, 0::BIGINT AS not_whole, 0::BIGINT AS needless_cuts, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM documents"


# 1: clusters of mutually similar vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.usable(C.table(spark, sf_dir, "words_model"), "word_id", "embeddings")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_members(_vectors(spark, sf_dir)).withColumnRenamed("id", "word_id")


@query
def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(_vectors(spark, sf_dir))


@query
def p1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of communities and their modularity, level by level."""
    return clusters.community_quality(_vectors(spark, sf_dir))


@query
def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per cluster of two or more, as sums over its communities."""
    report = clusters.cluster_report(_vectors(spark, sf_dir), smallest=1)
    return report.groupBy("cluster_id").agg(F.sum("size").alias("n_rows")).where("n_rows >= 2")


# 2: the same record in several splits


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).withColumnRenamed("triplet_id", "id")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(_records(spark, sf_dir))
    return pairs.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


@query
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: records, those with an overlap in train, and the pairs."""
    rows = _records(spark, sf_dir)
    held = overlap.split_name(rows.select("id", "split", "source")).where(F.col("split").isin(*overlap.EVALUATION)).join(overlap.overlap_counts(rows), "id", "left")
    return held.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


@query
def p2_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in all, and those that shared chunks led to."""
    return overlap.overlap_counts(_records(spark, sf_dir)).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("by_chunks"), F.lit(0)).alias("by_chunks"))


@query
def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each held-out record's words that stand in chunks which train has too."""
    got = overlap.chunk_overlap(_records(spark, sf_dir))
    return got.select(F.col("id").alias("triplet_id"), "n_words", "shared", F.round(F.col("shared") / F.col("n_words"), 6).alias("fraction"))


# 5: most similar vectors


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, sf_dir))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@query
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, sf_dir))
    return near.select(F.col("id").alias("word_id"), F.col("other").alias("other_id"), F.round("similarity", 6).alias("similarity"), "rank")


# 9: subjects of the documents


def _subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, subjects.Fitted | None]:
    names = sorted(r["subject"] for r in C.table(spark, sf_dir, "subjects").select("subject").distinct().collect() if r["subject"])  # a fixed list
    return subjects.fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "subject_labels"), names)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assigned(*_subjects(spark, sf_dir)).where("4 * about >= sentences").select("doc_id", "subject")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each subject, its share of all documents with a text, and of all sentences about any subject."""
    rows = C.cut(subjects.assigned(*_subjects(spark, sf_dir)))
    n_docs = C.table(spark, sf_dir, "documents").where("text is not null").count()
    whole = rows.agg(F.sum("about")).first()[0] or 1
    per = rows.groupBy("subject").agg(F.sum(F.when(F.expr("4 * about >= sentences"), 1).otherwise(0)).alias("docs"), F.sum("about").alias("n_sentences"))
    return per.select("subject", "docs", F.round(F.col("docs") / max(n_docs, 1), 6).alias("share_of_docs"), F.round(F.col("n_sentences") / whole, 6).alias("share_of_sentences"))


@query
def p9_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.leaf_report(*_subjects(spark, sf_dir))


# SQL of the searches: every pair of the whole tables, so only for small ones

_V = """v AS (SELECT word_id AS i, max_by(embeddings, loaded_at)::DOUBLE[] AS e FROM words_model WHERE len(embeddings) = 64 GROUP BY word_id),
u AS (SELECT i, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.i AS a, b.i AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) AS s FROM u a JOIN u b ON a.i <> b.i),
k AS (SELECT a, b, s FROM l WHERE s >= 0.8)"""
SQL["p1_found"] = f"""WITH RECURSIVE {_V}, r(i, c) AS (SELECT i, i FROM u UNION SELECT k.b, r.c FROM r JOIN k ON k.a = r.i),
m AS (SELECT i, min(c) AS c FROM r GROUP BY i)
SELECT c AS cluster_id, i AS word_id FROM m WHERE c IN (SELECT c FROM m GROUP BY c HAVING count(*) >= 3)"""
SQL["p1_sizes"] = f"""WITH RECURSIVE {_V}, r(i, c) AS (SELECT i, i FROM u UNION SELECT k.b, r.c FROM r JOIN k ON k.a = r.i),
m AS (SELECT i, min(c) AS c FROM r GROUP BY i) SELECT c AS cluster_id, count(*) AS n_rows FROM m GROUP BY c HAVING count(*) >= 2"""
SQL["p5_found"] = f"WITH {_V} SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM k) WHERE r <= 5"
SQL["p5_neighbours"] = f"WITH {_V} SELECT a AS word_id, b AS other_id, round(s, 6) AS similarity, r::INTEGER AS rank FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM k) WHERE r <= 5"
_T = "t AS (SELECT triplet_id AS id, max_by(anchor, loaded_at) AS anchor, max_by(positive, loaded_at) AS positive, max_by(negative, loaded_at) AS negative, max_by(author_id, loaded_at) AS author, max_by(lower(regexp_replace(split, '\\s+', '', 'g')), loaded_at) AS split FROM triplets GROUP BY triplet_id)"
_W = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)))"
_NEAR = "10 * len(list_intersect(x.{0}, y.{0})) >= 7 * (len(x.{0}) + len(y.{0}) - len(list_intersect(x.{0}, y.{0})))"
SQL["p2_found"] = f"""WITH {_T}, w AS (SELECT id, split, {_W.format('anchor')} AS a, {_W.format('positive')} AS p, {_W.format('negative')} AS n FROM t),
f AS (SELECT * FROM w WHERE len(a) > 0 AND len(p) > 0 AND len(n) > 0)
SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM f x JOIN f y ON x.split = 'train' AND y.split IN ('validation', 'test')
WHERE {_NEAR.format('p')} AND {_NEAR.format('n')} AND {_NEAR.format('a')}"""
_P = SQL["p2_found"].replace("SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM", ", pr AS (SELECT x.id AS t, y.id AS e FROM") + ")"
SQL["p2_report"] = _P + """, n AS (SELECT e, count(*) AS pairs FROM pr GROUP BY e), s AS (SELECT triplet_id AS id, max_by(lower(regexp_replace(split, '\\s+', '', 'g')), loaded_at) AS split, max_by(source, loaded_at) AS source FROM triplets GROUP BY triplet_id)
SELECT split, source, count(*) AS n_rows, count(pairs) AS overlapping, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM s LEFT JOIN n ON n.e = s.id WHERE split IN ('validation', 'test') GROUP BY split, source"""
_C = r"""c AS (SELECT id, split, f, list_transform(regexp_extract_all(coalesce(x, ''), '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM t, LATERAL (SELECT unnest([{'f': 'anchor', 'x': anchor}, {'f': 'positive', 'x': positive}, {'f': 'negative', 'x': negative}], recursive := true))),
w AS (SELECT id, split, f, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM c),
g AS (SELECT *, coalesce(sum((('0x' || md5(right(w, 4))[1:4])::INTEGER % 4 = 0)::INTEGER) OVER (PARTITION BY id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w),
k AS (SELECT id, split, f, string_agg(w, ' ' ORDER BY i) AS k, count(*) AS n FROM g GROUP BY id, split, f, g),
h AS (SELECT DISTINCT f, k FROM k WHERE split = 'train')
SELECT k.id AS triplet_id, sum(n)::BIGINT AS n_words, sum(CASE WHEN h.k IS NULL THEN 0 ELSE n END)::BIGINT AS shared, round(sum(CASE WHEN h.k IS NULL THEN 0 ELSE n END) / sum(n), 6) AS fraction
FROM k LEFT JOIN h ON h.f = k.f AND h.k = k.k WHERE k.split IN ('validation', 'test') GROUP BY k.id"""
SQL["p2_chunks"] = f"WITH {_T}, {_C}"
SQL["p3_found"] = f"""WITH RECURSIVE {_T}, g AS (SELECT id, author, nullif(lower(regexp_replace(regexp_replace(anchor, '<[^>]*>|&([A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '') AS k FROM t),
e AS (SELECT DISTINCT author, k FROM g WHERE author IS NOT NULL AND k IS NOT NULL),
r(author, c) AS (SELECT author, author FROM e UNION SELECT y.author, r.c FROM r JOIN e x ON x.author = r.author JOIN e y ON y.k = x.k),
m AS (SELECT author, min(c) AS c FROM r GROUP BY author), mk AS (SELECT k, min(c) AS c FROM e JOIN m USING (author) GROUP BY k)
SELECT id AS triplet_id, coalesce(mk.c, m.c, g.author) AS group_id FROM g LEFT JOIN mk ON mk.k = g.k LEFT JOIN m ON m.author = g.author"""
