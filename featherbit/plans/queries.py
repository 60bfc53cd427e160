"""Queries over the core operators, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.planning import computed, cut, shared_folder, spread
from ..operators import bits as bits_of
from ..operators import clustering, corex, explore, preparation, ranking, similarity, tokenizer, tsetlin
from ..sources import readers
from ..sources.registry import Registry
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = tokenizer.Params(max_df=0.95, min_df=0.02, max_len=20, min_len=2, ngrams=3, cgrams=3)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def joined(c: str) -> F.Column:
    """An array as one string, so that every engine hashes it alike."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# the SQL of the tokenizer, once for all its queries

_WS = "list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: length(w) BETWEEN 2 AND 20), lambda w: lower(w))"
_CH = "CASE WHEN length(w) > 3 THEN flatten(list_transform(range(1, length(w) - 1), lambda s: list_transform(range(2, 4), lambda n: substring(w, s, n)))) ELSE []::VARCHAR[] END"
_NG = "list_transform(range(least(i - 1, 2), -1, -1), lambda k: array_to_string(ws[i - k:i], ' '))"
_FS = f"flatten(list_transform(ws, lambda w, i: list_concat({_CH}, {_NG})))"
_DOCS = f"d AS (SELECT doc_id, {_WS} AS ws FROM documents)"
_DF = f"{_DOCS}, df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_FS})) AS token FROM d) GROUP BY token)"
_VOCAB = f"{_DF}, v AS (SELECT token, df FROM df WHERE df / (SELECT count(*)::DOUBLE FROM documents) BETWEEN 0.02 AND 0.95), ids AS (SELECT token, df, (row_number() OVER (ORDER BY df DESC, token) - 1)::INTEGER AS id FROM v)"
_KNOWN = f"""{_VOCAB},
e AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT doc_id, list(token ORDER BY pos) AS ws FROM e WHERE token IN (SELECT token FROM v) GROUP BY doc_id),
f AS (SELECT doc_id, {_FS} AS fs FROM k)"""
_BITS = f"""{_KNOWN},
x AS (SELECT doc_id, unnest(list_distinct(fs)) AS token FROM f),
b0 AS (SELECT doc_id, list(id ORDER BY id) AS ids FROM x JOIN ids USING (token) GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(ids, []::INTEGER[]) AS ids FROM documents LEFT JOIN b0 USING (doc_id))"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.with_words(documents(spark, sf_dir), P, "doc_id", "text")


def vocabulary(spark: SparkSession, sf_dir: str) -> tokenizer.Vocabulary:
    return tokenizer.Vocabulary(P).train(documents(spark, sf_dir)).finalize()


@query(f"WITH {_DOCS} SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d")
def words_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", F.posexplode("ws").alias("pos", "word")).select("doc_id", "word", (F.col("pos") + 1).cast("bigint").alias("pos"))


def _digest(df: DataFrame, name: str) -> DataFrame:
    return df.select("doc_id", F.size(name).cast("bigint").alias("n"), F.md5(F.array_join(name, ",")).alias("digest"))


@query(f"WITH {_DOCS}, c AS (SELECT doc_id, flatten(list_transform(ws, lambda w: {_CH})) AS g FROM d) SELECT doc_id, len(g) AS n, md5(array_to_string(g, ',')) AS digest FROM c")
def char_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(computed(_words(spark, sf_dir), "g", tokenizer.char_grams("ws", P)), "g")


@query(f"WITH {_DOCS}, c AS (SELECT doc_id, flatten(list_transform(ws, lambda w, i: {_NG})) AS g FROM d) SELECT doc_id, len(g) AS n, md5(array_to_string(g, ',')) AS digest FROM c")
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(computed(_words(spark, sf_dir), "g", tokenizer.word_ngrams("ws", P)), "g")


@query(f"WITH {_DOCS}, c AS (SELECT doc_id, {_FS} AS g FROM d) SELECT doc_id, len(g) AS n, md5(array_to_string(g, ',')) AS digest FROM c")
def features_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(computed(_words(spark, sf_dir), "g", tokenizer.features("ws", P)), "g")


@query(f"WITH {_DF} SELECT token, df FROM df")
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.document_frequency(documents(spark, sf_dir), P)


@query(f"WITH {_VOCAB} SELECT token, df FROM v")
def vocab_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.Vocabulary(P).train(documents(spark, sf_dir)).pruned()


@query(f"WITH {_VOCAB} SELECT token, df, id FROM ids")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).df


@query(f"WITH {_VOCAB} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_features FROM v")
def feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tokenizer.Vocabulary(P).train(documents(spark, sf_dir))
    return v.pruned().agg(F.count("*").alias("n_features")).select(F.lit(v.n_docs).cast("bigint").alias("n_docs"), "n_features")


@query(f"WITH {_DF} SELECT token, df FROM df")
def incremental_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves trained one after the other; the result is that of one training."""
    docs = documents(spark, sf_dir)
    return tokenizer.Vocabulary(P).train(docs.where("doc_id % 2 = 0")).train(docs.where("doc_id % 2 = 1")).df


@query(f"WITH {_BITS} SELECT doc_id, len(ids) AS n, array_to_string(ids, ',') AS ids FROM b")
def bitmap_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tokenizer.fingerprints(documents(spark, sf_dir), vocabulary(spark, sf_dir))
    return b.select("doc_id", F.size("ids").cast("bigint").alias("n"), joined("ids").alias("ids"))


@query(SQL["bitmap_tokenize"])
def bitmap_tokenize_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for vocabularies too large to send to the workers."""
    b = tokenizer.joined_fingerprints(documents(spark, sf_dir), vocabulary(spark, sf_dir))
    return b.select("doc_id", F.size("ids").cast("bigint").alias("n"), joined("ids").alias("ids"))


@query(f"""WITH {_KNOWN}, o AS (SELECT doc_id, list_filter(fs, lambda t: list_contains((SELECT list(token) FROM v), t)) AS t FROM f)
SELECT doc_id, coalesce(len(t), 0)::BIGINT AS n, md5(coalesce(array_to_string(t, ','), '')) AS digest FROM documents LEFT JOIN o USING (doc_id)""")
def parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(tokenizer.parse(documents(spark, sf_dir), vocabulary(spark, sf_dir)), "tokens")


SQL["parse_tokens"] = f"""WITH {_KNOWN}, u AS (SELECT doc_id, unnest(fs) AS token, generate_subscripts(fs, 1) AS pos FROM f),
o AS (SELECT doc_id, list(token ORDER BY pos) AS t FROM u WHERE token IN (SELECT token FROM v) GROUP BY doc_id)
SELECT doc_id, coalesce(len(t), 0)::BIGINT AS n, md5(coalesce(array_to_string(t, ','), '')) AS digest FROM documents LEFT JOIN o USING (doc_id)"""


@query(f"WITH {_BITS}, u AS (SELECT doc_id, unnest(ids) AS id FROM b) SELECT token, count(*) AS docs, min(doc_id) AS first_doc FROM u JOIN ids USING (id) GROUP BY token")
def fingerprint_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    s = tokenizer.strings_of(tokenizer.fingerprints(documents(spark, sf_dir), v), v)
    return s.groupBy("token").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


# sets of bits


def _bits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    v = vocabulary(spark, sf_dir)
    return tokenizer.fingerprints(documents(spark, sf_dir), v), v.size()


@query(f"""WITH {_BITS}, n AS (SELECT count(*)::INTEGER AS bits FROM v)
SELECT doc_id, bits::BIGINT AS n, md5(array_to_string(list_concat(ids, list_transform(list_filter(range(0, bits), lambda i: NOT list_contains(ids, i)), lambda i: i + bits)), ',')) AS digest FROM b, n""")
def flip_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bits = _bits(spark, sf_dir)
    full = computed(b, "l", S.with_complement(F.col("ids"), bits))
    return full.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(joined("l")).alias("digest"))


_TRIPLES = """t AS (SELECT triplet_id, max_by(anchor, loaded_at) AS a, max_by(positive, loaded_at) AS p, max_by(negative, loaded_at) AS n FROM triplets GROUP BY triplet_id),
s AS (SELECT triplet_id, list_distinct(WA) AS a, list_distinct(WP) AS p, list_distinct(WN) AS n FROM t)"""
for _c in "apn":
    _TRIPLES = _TRIPLES.replace(f"W{_c.upper()}", _WS.replace("text", _c))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triplet_id, a, p, n): sets of words of the three sentences; of repeated rows the one loaded last."""
    t = table(spark, sf_dir, "triplets").groupBy("triplet_id").agg(F.max_by(F.struct(F.col("anchor").alias("a"), F.col("positive").alias("p"), F.col("negative").alias("n")), "loaded_at").alias("t"))
    for c in "apn":
        t = computed(t, c, F.array_distinct(tokenizer.words(F.col(f"t.{c}"), P)))
    return t.select("triplet_id", "a", "p", "n")


@query(f"WITH {_TRIPLES} SELECT triplet_id, len(a) + len(p) - 2 * len(list_intersect(a, p)) AS to_positive, len(a) + len(n) - 2 * len(list_intersect(a, n)) AS to_negative FROM s")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p, n = (F.col(c) for c in "apn")
    return _triples(spark, sf_dir).select("triplet_id", S.hamming(a, p).alias("to_positive"), S.hamming(a, n).alias("to_negative"))


@query(f"WITH {_TRIPLES} SELECT triplet_id, round(CASE WHEN len(a) + len(p) = 0 THEN 1.0 ELSE len(list_intersect(a, p)) / len(list_distinct(list_concat(a, p)))::DOUBLE END, 6) AS similarity FROM s")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).select("triplet_id", F.round(S.jaccard(F.col("a"), F.col("p")), 6).alias("similarity"))


@query(f"WITH {_TRIPLES} SELECT round(avg(CASE WHEN len(p) - 2 * len(list_intersect(a, p)) < len(n) - 2 * len(list_intersect(a, n)) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM s")
def triplet_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of triplets whose anchor is strictly nearer to the positive sentence."""
    a, p, n = (F.col(c) for c in "apn")
    nearer = (S.hamming(a, p) < S.hamming(a, n)).cast("double")
    return _triples(spark, sf_dir).agg(F.round(F.avg(nearer), 6).alias("accuracy"), F.count("*").alias("n"))


@query(f"""WITH {_BITS}, p AS (SELECT doc_id, lead(ids) OVER (ORDER BY doc_id) AS nxt, ids FROM b)
SELECT doc_id, (len(ids) + len(nxt) - 2 * len(list_intersect(ids, nxt)))::BIGINT AS distance, (2 * (len(ids) + len(nxt) - 2 * len(list_intersect(ids, nxt))))::BIGINT AS flipped FROM p WHERE nxt IS NOT NULL""")
def packed_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next id, on packed words; on literals with their complements the distance is twice as large."""
    b, bits = _bits(spark, sf_dir)
    b = cut(b)
    full = cut(bits_of.pack(b, "doc_id", "ids", bits).withColumnRenamed("words", "w").join(bits_of.pack(b, "doc_id", "ids", bits, True).withColumnRenamed("words", "f"), "doc_id"))
    nxt = full.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"), F.col("f").alias("f2"))
    return full.join(nxt, "doc_id").select("doc_id", S.packed_hamming(F.col("w"), F.col("w2")).alias("distance"), S.packed_hamming(F.col("f"), F.col("f2")).alias("flipped"))


# scalar functions and cleaning


@query(r"""SELECT sentence_id, array_to_string(list_transform(list_filter(regexp_split_to_array(anchor, '[ \t\n\v\f\r]+'), lambda x: x <> ''),
lambda x: regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), ' ') AS words FROM sentences WHERE anchor IS NOT NULL""")
def split_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sentences").where("anchor is not null")
    return s.select("sentence_id", F.array_join(S.split_words(F.col("anchor")), " ").alias("words"))


@query(r"SELECT sample_id, regexp_replace(review, '[\t\n]', '', 'g') AS review FROM samples")
def review_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.clean_reviews(table(spark, sf_dir, "samples"), "review").select("sample_id", "review")


@query("SELECT doc_id, (ceil(n_chars / 128.0) * 128)::BIGINT AS width FROM documents")
def round_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.round_multiple(F.col("n_chars"), 128).alias("width"))


# labelled pairs, samples and splits

_PAIRS = "pairs AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'entailment' WHEN 'O' THEN 'neutral' WHEN 'P' THEN 'contradiction' END AS label, o_custkey AS a, o_orderpriority AS b FROM orders), sets AS (SELECT DISTINCT a, label, b FROM pairs WHERE label IS NOT NULL)"
_TRIP = f"{_PAIRS}, trip AS (SELECT p.a AS anchor, p.b AS positive, n.b AS negative FROM sets p JOIN sets n USING (a) WHERE p.label = 'entailment' AND n.label <> 'entailment')"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for x in ("F", "entailment", "O", "neutral", "P", "contradiction")])
    return table(spark, sf_dir, "orders").select(label[F.col("o_orderstatus")].alias("label"), F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))


@query(f"WITH {_PAIRS} SELECT a, label, count(*) AS n, array_to_string(list(b ORDER BY b), '|') AS sentences FROM sets GROUP BY a, label")
def nli_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = preparation.pair_sets(pairs(spark, sf_dir))
    return sets.groupBy("a", "label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("b")), "|").alias("sentences"))


@query(f"WITH {_TRIP} SELECT anchor, positive, negative FROM trip")
def nli_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.triplets_of(pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT DISTINCT text FROM (SELECT a::VARCHAR AS text FROM sets UNION ALL SELECT b FROM sets)")
def nli_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.sentences_of(preparation.pair_sets(pairs(spark, sf_dir)), "a", "b")


@query(f"""WITH {_TRIP}, r AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || anchor || '|' || positive || '|' || negative), anchor, positive, negative) AS k FROM trip)
SELECT anchor, positive, negative, CASE WHEN k <= floor((SELECT count(*) FROM trip) * 0.9) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = preparation.triplets_of(pairs(spark, sf_dir))
    train, test = ranking.train_test(t, 7, ["anchor", "positive", "negative"], 0.9)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) AS rank FROM documents")
def shuffle_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents").select("doc_id"), 3, ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY md5('5|' || doc_id), doc_id LIMIT 100")
def sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: just 100 rows in the shuffled order of a seed."""
    return ranking.first_rows(table(spark, sf_dir, "documents").select("doc_id"), 5, ["doc_id"], 100)[0]


_SAMPLES = "s AS (SELECT sample_id, try_cast(max_by(trim(label), loaded_at) AS INTEGER) AS label, max_by(review, loaded_at) AS review FROM samples GROUP BY sample_id)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.max_by(F.struct(F.trim("label").try_cast("int").alias("label"), F.col("review").alias("text")), "loaded_at")
    return table(spark, sf_dir, "samples").groupBy("sample_id").agg(row.alias("r")).select("sample_id", "r.label", "r.text")


@query(f"""WITH {_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || sample_id), sample_id) AS pair FROM s WHERE label IN (0, 1))
SELECT p.pair, p.sample_id AS positive_id, n.sample_id AS negative_id FROM r p JOIN r n USING (pair) WHERE p.label = 1 AND n.label = 0""")
def samples_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.balanced_samples(samples(spark, sf_dir))


@query("SELECT source AS label, (row_number() OVER (ORDER BY f, source) - 1)::INTEGER AS label_id FROM (SELECT source, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY source)")
def label_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.label_dictionary(table(spark, sf_dir, "documents"), "doc_id", "source")


@query("SELECT label_id, count(*) AS n FROM (SELECT source, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INTEGER AS label_id FROM documents WHERE source IS NOT NULL GROUP BY source) JOIN documents USING (source) GROUP BY label_id")
def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return preparation.with_label_ids(docs, preparation.label_dictionary(docs, "doc_id", "source"), "source").groupBy("label_id").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT subject AS label FROM subject_labels UNION ALL SELECT kind FROM documents) SELECT label, count(*) AS n FROM o WHERE label IS NOT NULL AND label NOT IN (SELECT subject FROM subjects) GROUP BY label")
def label_dict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings and kinds of documents that a dictionary of the subjects doesn't know."""
    known = preparation.label_dictionary(table(spark, sf_dir, "subjects"), "about", "subject")
    asked = table(spark, sf_dir, "subject_labels").select(F.col("subject").alias("label")).unionByName(table(spark, sf_dir, "documents").select(F.col("kind").alias("label")))
    return asked.where("label is not null").join(known, "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_SAMPLES} SELECT (max(label) + 1)::BIGINT AS by_maximum, count(DISTINCT label) AS by_values FROM s")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.class_counts(samples(spark, sf_dir))


# vectors and clusters

_UNIT = "u AS (SELECT vec_id AS i, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_SIM = f"{_UNIT}, s AS (SELECT a.i AS i, b.i AS j, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a, u b)"
_MED = "m AS (SELECT (row_number() OVER (ORDER BY i) - 1) AS cluster, i, v FROM (SELECT i, v FROM u ORDER BY i LIMIT 8))"
_ASG = f"{_UNIT}, {_MED}, ms AS (SELECT u.i AS i, m.cluster AS cluster, round(list_dot_product(u.v, m.v), 9) AS sim FROM u, m), asg AS (SELECT i, cluster, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, cluster) AS r FROM ms) WHERE r = 1)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _first_medoids(rows: DataFrame) -> DataFrame:
    ids = [r["i"] for r in rows.select("i").orderBy("i").limit(8).collect()]
    return clustering._medoids(rows, ids)


@query(f"WITH {_UNIT} SELECT i, round(unnest(v), 6) AS x, generate_subscripts(v, 1) AS d FROM u")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("i", F.posexplode("v").alias("d", "x")).select("i", F.round("x", 6).alias("x"), (F.col("d") + 1).cast("bigint").alias("d"))


@query(f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM s WHERE i <> j) WHERE r <= 3")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(units(spark, sf_dir))
    got = similarity.top_k(rows, rows.select(F.col("i").alias("j"), "v"), 3, itself=False)
    return got.select("i", "j", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim FROM s WHERE sim >= 0.35")
def eps_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.neighbourhoods(cut(units(spark, sf_dir)), 0.35).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"WITH {_ASG} SELECT i, cluster, round(sim, 6) AS sim FROM asg")
def kmedoids_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(units(spark, sf_dir))
    return clustering.assign(rows, _first_medoids(rows)).select("i", "cluster", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_ASG}, mem AS (SELECT asg.cluster, u.i, u.v FROM asg JOIN u USING (i)),
tot AS (SELECT a.cluster, a.i, round(sum(list_dot_product(a.v, b.v)), 6) AS total FROM mem a JOIN mem b USING (cluster) GROUP BY a.cluster, a.i)
SELECT cluster, i, total FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total DESC, i) AS r FROM tot) WHERE r = 1""")
def kmedoids_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(units(spark, sf_dir))
    return clustering.update(rows, clustering.assign(rows, _first_medoids(rows))).select("cluster", "i", F.round("total", 6).alias("total"))


@query(f"WITH {_UNIT}, {_MED}, ms AS (SELECT u.i AS i, m.cluster AS cluster, round(list_dot_product(u.v, m.v), 9) AS sim FROM u, m) SELECT i, cluster, round(sim, 6) AS sim, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, cluster) AS r FROM ms) WHERE r <= 3")
def soft_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(units(spark, sf_dir))
    got = similarity.top_k(rows, _first_medoids(rows).select(F.col("cluster").alias("j"), "v"), 3)
    return got.select("i", F.col("j").alias("cluster"), F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_UNIT}, {_MED}, ms AS (SELECT u.i AS i, m.cluster AS c, round(list_dot_product(u.v, m.v), 9) AS sim FROM u, m)
SELECT i, first(c ORDER BY sim DESC, c) AS nearest, round(max(sim), 6) AS nearest_sim, first(c ORDER BY sim, c) AS furthest, round(min(sim), 6) AS furthest_sim FROM ms GROUP BY i""")
def medoid_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(units(spark, sf_dir))
    got = similarity.extremes(rows, _first_medoids(rows).select(F.col("cluster").alias("j"), "v"))
    return got.select("i", "nearest", F.round("nearest_sim", 6).alias("nearest_sim"), "furthest", F.round("furthest_sim", 6).alias("furthest_sim"))


_DB = f"""{_SIM}, e AS (SELECT i, j, sim FROM s WHERE sim >= 0.35), core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 3),
cc AS (SELECT e.i, e.j FROM e JOIN core a ON a.i = e.i JOIN core b ON b.i = e.j),
reach(i, l) AS (SELECT i, i FROM core UNION SELECT cc.j, reach.l FROM reach JOIN cc ON cc.i = reach.i WHERE reach.l <= cc.j),
lab AS (SELECT i, min(l) AS l FROM reach GROUP BY i), num AS (SELECT i, dense_rank() OVER (ORDER BY l) AS cluster FROM lab),
bor AS (SELECT e.i, min(num.cluster) AS cluster FROM e JOIN num ON num.i = e.j GROUP BY e.i),
res AS (SELECT u.i, coalesce(num.cluster, bor.cluster, -1)::INTEGER AS cluster FROM u LEFT JOIN num ON num.i = u.i LEFT JOIN bor ON bor.i = u.i)"""


@query(f"WITH RECURSIVE {_DB} SELECT i, cluster FROM res".replace("UNION SELECT cc.j, reach.l FROM reach JOIN cc ON cc.i = reach.i WHERE reach.l <= cc.j", "UNION SELECT cc.j, reach.l FROM reach JOIN cc ON cc.i = reach.i"))
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = cut(similarity.neighbourhoods(cut(units(spark, sf_dir)), 0.35))
    return clustering.dbscan_labels(near, 3)


@query(f"""WITH RECURSIVE {_DB}, oth AS (SELECT e.i, res.cluster, max(e.sim) AS sim FROM e JOIN res ON res.i = e.j WHERE res.cluster > 0 GROUP BY e.i, res.cluster),
al AS (SELECT i, cluster, 1.0::DOUBLE AS sim, true AS own FROM res WHERE cluster > 0 UNION ALL SELECT o.i, o.cluster, o.sim, false FROM oth o JOIN res USING (i) WHERE o.cluster <> res.cluster)
SELECT i, cluster, round(sim, 6) AS sim, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY own DESC, sim DESC, cluster) AS r FROM al) WHERE r <= 3""".replace("UNION SELECT cc.j, reach.l FROM reach JOIN cc ON cc.i = reach.i WHERE reach.l <= cc.j", "UNION SELECT cc.j, reach.l FROM reach JOIN cc ON cc.i = reach.i"))
def dbscan_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clustering.dbscan(units(spark, sf_dir), 3, 0.35, 3)
    return got.select("i", "cluster", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("WITH c AS (SELECT vec_id AS i, sum(1 + vec_id % 7) OVER (ORDER BY vec_id) / (SELECT sum(1 + vec_id % 7)::DOUBLE FROM embeddings) AS c FROM embeddings) SELECT min(i) AS i FROM c WHERE c >= 0.37")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), (1 + F.col("vec_id") % 7).cast("double").alias("w"))
    return clustering.choose(w, 0.37)


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS t, avg(value) AS x FROM events GROUP BY ALL),
s AS (SELECT event_type, row_number() OVER w AS n, abs(avg(x) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(x) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)) AS d FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, min(CASE WHEN n >= 10 AND d < 0.5 THEN n END) AS n FROM s GROUP BY event_type""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the daily means of each event type have settled; a series has one value a day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("t")).agg(F.avg("value").alias("x"))
    return clustering.early_stops(days, "event_type", ["t"], "x", 0.5)


@query("SELECT word_id, word FROM words_model WHERE word IN (SELECT word FROM words_model w JOIN clusters c ON c.id_words = w.word_id WHERE c.id_clusters_model = 1)")
def filter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that an earlier clustering holds."""
    w = table(spark, sf_dir, "words_model").select("word_id", "word")
    held = table(spark, sf_dir, "clusters").where("id_clusters_model = 1").select(F.col("id_words").alias("word_id"))
    return clustering.filter_words(w, w.join(held, "word_id", "left_semi"))


@query("SELECT count(*) AS n_rows, 8::BIGINT AS clusters, 0::BIGINT AS misplaced, 0::BIGINT AS better_medoids, 0::BIGINT AS bad_ranks FROM embeddings")
def kmedoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole clustering, and how often it breaks what a settled one must keep: rows not at their most similar medoid, clusters
    with a better medoid than theirs, rows without two ranked clusters."""
    rows = cut(units(spark, sf_dir))
    got = cut(clustering.create(rows, "k-medoids", 8, 2))
    own = got.where("rank = 1").select("i", "cluster", "sim")
    medoids = own.groupBy("cluster").agg(F.min_by("i", F.struct(-F.col("sim"), "i")).alias("m"))
    held = cut(medoids.join(rows.withColumnRenamed("i", "m"), "m"))
    again = clustering.assign(rows, held.select("cluster", "v")).select("i", F.col("cluster").alias("best"))
    misplaced = own.join(again, "i").where("cluster <> best").agg(F.count("*").alias("misplaced"))
    best = clustering.update(rows, own).select("cluster", "i")
    better = best.join(medoids, "cluster").where("i <> m").agg(F.count("*").alias("better_medoids"))
    ranks = got.groupBy("i").agg(F.sort_array(F.collect_list("rank")).alias("r")).agg(F.count("*").alias("n_rows"), F.sum((F.col("r") != F.array(F.lit(1), F.lit(2))).cast("bigint")).alias("bad_ranks"))
    return ranks.crossJoin(medoids.agg(F.count("*").alias("clusters"))).crossJoin(misplaced).crossJoin(better)  # of one row each


# learning


@query(f"""WITH {_BITS}, c AS (SELECT k::INTEGER AS k, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS class, CASE WHEN k % 4 < 2 THEN 1 ELSE -1 END AS sign FROM range(0, 64) t(k)),
w AS (SELECT doc_id, class, sum(CASE WHEN list_contains(ids, k) AND NOT list_contains(ids, 3 * k + 1) THEN sign ELSE 0 END)::BIGINT AS votes FROM b, c GROUP BY doc_id, class)
SELECT doc_id, class AS label, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, class) AS r FROM w) WHERE r = 1""")
def tm_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of 64 given clauses: feature k present and feature 3k + 1 absent."""
    b = tokenizer.fingerprints(documents(spark, sf_dir), vocabulary(spark, sf_dir))
    k = F.col("id").cast("int")
    clauses = spark.range(64).select(F.when(k % 2 == 0, "even").otherwise("odd").alias("class"), F.when(k % 4 < 2, 1).otherwise(-1).alias("sign"), F.array(k).alias("present"), F.array(3 * k + 1).alias("absent"))
    votes = tsetlin.vote(b, clauses)
    return votes.groupBy("doc_id").agg(F.min_by("class", F.struct(-F.col("votes"), "class")).alias("label"), F.max("votes").alias("votes"))


_SMALL = tokenizer.Params(max_df=0.7, min_df=0.02, max_len=20, min_len=2, ngrams=1, cgrams=0)


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Documents as fingerprints of words, labelled by whether they are said to be in English."""
    lang = F.when(F.lower(F.substring("lang", 1, 2)) == "en", "english").otherwise("other")
    docs = cut(spread(table(spark, sf_dir, "documents").where("lang is not null and text is not null").select("doc_id", "text", lang.alias("kind"))))
    v = tokenizer.Vocabulary(_SMALL).train(docs).finalize()
    prints = tokenizer.fingerprints(docs, v).join(docs.select("doc_id", "kind"), "doc_id")
    return cut(prints.select("doc_id", "ids", F.col("kind").alias("label"), (F.col("kind") == "other").cast("int").alias("label_id"))), v.size()


@query()
def tm_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a classifier on held-out documents, and of the more frequent class."""
    rows, bits = _labelled(spark, sf_dir)
    train, test = ranking.train_test(rows, 1, ["doc_id"], 0.8)
    m = tsetlin.train_classifier(train, bits, 2, tsetlin.Settings(clauses=20, target=10, specificity_high=10.0, iterations=2))
    said = tsetlin.classify(test, m, ["english", "other"]).withColumnRenamed("label", "said")
    right = F.avg((F.col("label") == F.col("said")).cast("double"))
    return said.join(test.select("doc_id", "label"), "doc_id").agg(right.alias("accuracy"), F.greatest(F.avg((F.col("label") == "english").cast("double")), F.avg((F.col("label") == "other").cast("double"))).alias("majority"), F.count("*").alias("n"))


@query()
def compress_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, bits = _labelled(spark, sf_dir)
    return corex.compress(rows, corex.fit(rows, bits, 16, iterations=6), bits).select("doc_id", joined("code").alias("code"))


@query()
def encoder_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of triplets whose codes put the anchor nearer to the positive sentence, after training on nine tenths."""
    t = _triples(spark, sf_dir).where("size(a) > 0 and size(p) > 0 and size(n) > 0")
    t = cut(t)
    words = t.select(F.explode(F.array_distinct(F.concat("a", "p", "n"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    known = tokenizer.Vocabulary(tokenizer.Params(min_df=0.01), t.count(), words).finalize()
    of = {r["token"]: r["id"] for r in known.df.collect()}  # at most 100 times as many as words in a triplet
    number = F.create_map(*[F.lit(x) for w, i in of.items() for x in (w, i)])
    ids = lambda c: F.array_sort(F.filter(F.transform(c, lambda w: number[w]), lambda i: i.isNotNull()))
    rows = cut(t.select("triplet_id", *[ids(c).alias(c) for c in "apn"]))
    train, test = ranking.train_test(rows, 2, ["triplet_id"], 0.9)
    m = tsetlin.train_encoder(train, len(of), 16, tsetlin.Settings(clauses=8, target=4, specificity_high=10.0, iterations=1))
    codes = [tsetlin.encode(test, m, "triplet_id", c).withColumnRenamed("code", f"y{c}") for c in "apn"]
    both = codes[0].join(codes[1], "triplet_id").join(codes[2], "triplet_id")
    nearer = S.hamming(F.col("ya"), F.col("yp")) < S.hamming(F.col("ya"), F.col("yn"))
    return both.agg(F.round(F.avg(nearer.cast("double")), 6).alias("score"), F.count("*").alias("n"))


@query()
def explore_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the classifier's options: every reachable draw is trained on four fifths and scored on the others, best first."""
    rows, bits = _labelled(spark, sf_dir)
    train, test = (cut(x) for x in ranking.train_test(rows, 1, ["doc_id"], 0.8))

    def run(o: dict) -> float:
        s = tsetlin.Settings(clauses=o["clauses"], target=o["target"], specificity_high=o["specificity"], iterations=1)
        return tsetlin.accuracy(test, tsetlin.train_classifier(train, bits, 2, s))

    found = explore.search({"clauses": [8, 16], "target": [4, 8, 16], "specificity": [5.0]}, run)
    return spark.createDataFrame([(n, o["clauses"], o["target"], o["specificity"], score) for n, o, score in found], "name string, clauses int, target int, specificity double, score double")


# text formats and saved models: the tables written in the formats and read again


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_ONE_LINE = "regexp_replace(coalesce({}, ''), '[\\t\\n\\r]', ' ', 'g')"


def _one_line(c: str) -> F.Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\r]", " ")


@query(f"SELECT text, count(*) AS n FROM (SELECT {_ONE_LINE.format('text')} AS text FROM documents) GROUP BY text")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    readers.write_fields(documents(spark, sf_dir).select(_one_line("text").alias("text")), path, "text")
    return readers.lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most, count(*) AS different FROM documents")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several files are numbered without gaps."""
    path = _folder(spark)
    readers.write_fields(documents(spark, sf_dir).select(_one_line("text").alias("text")), path, "text")
    return readers.lines(spark, path).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_distinct("doc_id").alias("different"))


@query(f"WITH {_SAMPLES} SELECT label, {_ONE_LINE.format('review')} AS text, count(*) AS n FROM s WHERE label IS NOT NULL GROUP BY ALL")
def samples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    readers.write_fields(samples(spark, sf_dir).where("label is not null").select("label", _one_line("text").alias("text")), path, "label", "text")
    return readers.samples(spark, path).groupBy("label", "text").agg(F.count("*").alias("n"))


@query(f"SELECT anchor, positive, negative, count(*) AS n FROM (SELECT {', '.join(f'{_ONE_LINE.format(c)} AS {c}' for c in ('anchor', 'positive', 'negative'))} FROM triplets) GROUP BY ALL")
def triplets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, cols = _folder(spark), ("anchor", "positive", "negative")
    readers.write_fields(table(spark, sf_dir, "triplets").select(*[_one_line(c).alias(c) for c in cols]), path, *cols)
    return readers.triplets(spark, path).groupBy(*cols).agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT label, a::VARCHAR AS a, b, count(*) AS n FROM pairs GROUP BY ALL")
def pairs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines of 14 columns with a header in each file."""
    path = _folder(spark)
    p = pairs(spark, sf_dir).select("label", *[F.lit("_").alias(f"_{i}") for i in range(2, 6)], F.col("a").cast("string").alias("a"), "b", *[F.lit("rest").alias(f"r{i}") for i in range(7)])
    p.write.csv(path, sep="\t", header=True, quote="")
    return readers.labelled_pairs(spark, path).groupBy("label", "a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {_SAMPLES} SELECT label, regexp_replace(coalesce(review, ''), '[\\t\\n]', '', 'g') AS text, count(*) AS n FROM s WHERE label IN (0, 1) GROUP BY ALL")
def reviews_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per review in the folders of its label."""
    path = _folder(spark)
    rows = samples(spark, sf_dir).where("label in (0, 1)").select("sample_id", F.when(F.col("label") == 1, "pos").otherwise("neg").alias("side"), F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("sample_id").write.option("lineSep", "\x00").partitionBy("side", "sample_id").text(path)
    files = [f"{path}/side={x}/*" for x in ("pos", "neg")]
    got = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.regexp_replace("value", "\x00$", "").alias("value"))
    return got.select(F.when(F.col("f").contains("side=pos"), 1).otherwise(0).alias("label"), S.glue_lines(F.col("value")).alias("text")).groupBy("label", "text").agg(F.count("*").alias("n"))


_WORDS = r"""w AS (SELECT row_number() OVER (ORDER BY word_id) AS line, word_id, regexp_replace(lower(word), '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS word
FROM (SELECT DISTINCT word_id, word, embeddings FROM words_model WHERE word IS NOT NULL AND NOT regexp_matches(word, '[^\x21-\x7e]') AND len(embeddings) = 64))"""


@query(f"WITH {_WORDS} SELECT word, min(word_id) AS word_id FROM w WHERE word <> '' GROUP BY word")
def words_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text, loaded, saved and read again: of words met several times the first line stays."""
    path, w = _folder(spark), table(spark, sf_dir, "words_model")
    rows = w.where(F.col("word").isNotNull() & ~F.col("word").rlike(r"[^\x21-\x7e]") & (F.size("embeddings") == 64)).select("word_id", "word", "embeddings").distinct()
    vec = F.concat(F.col("embeddings"), F.array(F.col("word_id").cast("float")))  # the id as a 65th number, to tell rows apart
    readers.write_fields(rows.orderBy("word_id").select(F.concat_ws(" ", "word", F.array_join(F.transform(vec, lambda x: x.cast("string")), " ")).alias("line")), path, "line")
    reg = Registry(spark, _folder(spark))
    pipelines.load_words(reg, "w", readers.word_vectors(spark, path))
    return reg.table("words", "w", "words").select("word", F.element_at("vec", 65).cast("bigint").alias("word_id"))


@query(f"WITH {_VOCAB} SELECT token, df, id FROM ids")
def vocabulary_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents trained, saved, loaded, trained on, finalised, saved and loaded."""
    docs, reg = documents(spark, sf_dir), Registry(spark, _folder(spark))
    early, late = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")  # both halves are used
    reg.save_vocabulary("half", tokenizer.Vocabulary(P).train(early))
    reg.save_vocabulary("whole", reg.load_vocabulary("half").train(late).finalize())
    return reg.load_vocabulary("whole").df


@query("SELECT count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND kind IS NOT NULL) AS learnt, true AS same, true AS better FROM documents")
def models_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A modeler with compressor and a classifier over it, created, saved and loaded: classes are the kinds of documents.
    ``same``: the codes of the saved model are those of a second load; ``better``: more rows right than by the commonest class."""
    reg = Registry(spark, _folder(spark))
    docs = cut(spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("kind").alias("label"))))
    known = cut(docs.where("text is not null and label is not null"))
    pipelines.create_modeler(reg, "m", _SMALL, known, hidden=32, iterations=8, eps=1e-4, supervision=0.25)
    pipelines.create_classifier(reg, "c", "m", known, tsetlin.Settings(clauses=16, target=8, specificity_high=8.0, iterations=3))
    one, two = (cut(pipelines.model(Registry(spark, reg.root), "m", docs)) for _ in range(2))
    same = one.join(two.withColumnRenamed("ids", "again"), "doc_id").where("ids = again").count() == docs.count()
    said = pipelines.classify(reg, "c", known).withColumnRenamed("label", "said").join(known, "doc_id")
    most = known.groupBy("label").count().agg(F.max("count")).first()[0]
    right = said.where("said = label").count()
    return spark.createDataFrame([(docs.count(), known.count(), same, right > most)], "n bigint, learnt bigint, same boolean, better boolean")


@query(f"WITH {_SAMPLES} SELECT round(avg((label = 1)::INTEGER), 6) AS train, round(avg((label = 1)::INTEGER), 6) AS test, count(*) AS n FROM s WHERE label IN (0, 1)")
def scores_of_a_given_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score operator on a machine that always says class 1."""
    rows = cut(samples(spark, sf_dir).where("label in (0, 1)").select(F.array(F.lit(0)).alias("ids"), F.col("label").alias("label_id")))
    s = tsetlin.Settings(clauses=2, target=1, state_bits=2)
    states = [[[1, 1], [1, 1]], [[3, 1], [1, 1]]]  # of class 1 the first clause holds the feature that all rows have
    m = tsetlin.Machine(2, 1, s, np.array(states, dtype=np.int16))
    score = round(tsetlin.accuracy(rows, m), 6)
    return spark.createDataFrame([(score, score, rows.count())], "train double, test double, n bigint")
