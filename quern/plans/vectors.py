"""Queries of vectors, losses, sequences of tokens and small numeric helpers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.order import running
from quern.plans.catalog import query
from quern.plans.text import _DOMINANT_SQL, _MOST, _TOTAL, _sql_counts
from quern.runtime import ship, spread, table

# --- vectors -----------------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` nearest vectors (by cosine, ties by id) of each query, itself left out: ``query_id, vec_id, similarity, n``.

    Queries are sent to all rows in blocks of about ``block``, by one pass over the vectors each, so what is broadcast
    has a fixed size; similarities are matrix products, of which a task keeps the best ``k`` of each query.
    """
    ship(vectors.sparkSession)
    asked = queries.select("vec_id", "embedding")
    number = -(-asked.count() // block)
    rows = spread(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null"))
    found = [_nearest(rows, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(number)) == part), k) for part in range(number)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, n int")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def _nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    some = asked.collect()  # a block
    names = np.array([r.vec_id for r in some], "i8")
    matrix = np.array([r.embedding for r in some], "f8")
    norms = np.sqrt((matrix**2).sum(axis=1)) if len(some) else np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix, norms))

    def run(batches):
        names, matrix, norms = shared.value
        best = None
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.array(batch.column(1).to_pylist(), "f8")
            size = np.sqrt((own**2).sum(axis=1))
            scale = norms[:, None] * size[None, :]
            near = np.where(scale > 0, matrix @ own.T / np.where(scale > 0, scale, 1), 0.0).round(6) + 0.0
            near[names[:, None] == ids[None, :]] = -np.inf
            ids = np.broadcast_to(ids, near.shape)
            if best is not None:
                ids, near = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], near], axis=1)
            order = np.lexsort((ids, -near), axis=1)[:, :k]
            best = np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)
        if best is not None:
            query, (ids, near) = np.repeat(names, best[0].shape[1]), (x.ravel() for x in best)
            kept = np.isfinite(near)
            yield pa.RecordBatch.from_arrays([pa.array(query[kept]), pa.array(ids[kept]), pa.array(near[kept])], ["query_id", "vec_id", "similarity"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")


_COS = "round(case when list_dot_product(a.embedding::double[], a.embedding::double[]) > 0 and list_dot_product(b.embedding::double[], b.embedding::double[]) > 0 then list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) else 0 end, 6)"


@query("srt_2_neighbours", f"select query_id, vec_id, similarity, n::int as n from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as n from (select b.vec_id as query_id, a.vec_id, {_COS} as similarity from embeddings a join embeddings b on b.vec_id % 100 = 0 and a.vec_id <> b.vec_id)) where n <= 5")
def nearest(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours(vectors, vectors.filter("vec_id % 100 = 0"), 5)


@query("jon_20_one_against_all", f"select a.vec_id, {_COS} as similarity from embeddings a join embeddings b on b.vec_id = 0")
def one_against_all(spark, folder):
    vectors = table(spark, folder, "embeddings")
    one = F.broadcast(vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return vectors.join(one, how="cross").select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("mth_7_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(list_sum(embedding::double[]), 6) as total from embeddings")
def norms(spark, folder):
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.sqrt(dot(e, e)), 6).alias("norm"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("mth_3_unit_vectors", "select vec_id, round(list_dot_product(u, u), 6) as squared from (select vec_id, list_transform(embedding::double[], lambda x: x / case when list_dot_product(embedding::double[], embedding::double[]) > 0 then sqrt(list_dot_product(embedding::double[], embedding::double[])) else 1 end) as u from embeddings)")
def units(spark, folder):
    return table(spark, folder, "embeddings").withColumn("u", unit(F.col("embedding"))).select("vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("squared"))


def covariance(vectors: DataFrame) -> DataFrame:
    """``i, j, cov`` of all dimensions of the vectors (i <= j), with n - 1 (1 at least).

    A task adds up X and its products with itself around the first vector as origin; only d (d + 1) / 2 sums a task
    shuffle. Null vectors and those of another length than the first don't count.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null and size(embedding) > 0")
    first = rows.first()
    schema = "i int, j int, n bigint, si double, sj double, sij double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], "i int, j int, cov double")
    origin = np.array(first.embedding)

    def run(batches):
        d = len(origin)
        n, sums, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(0).to_pylist()) - origin
                n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype("i4"), j.astype("i4"), np.full(len(i), n), sums[i], sums[j], products[i, j])], ["i", "j", "n", "si", "sj", "sij"])

    parts = spread(rows.filter(F.size("embedding") == len(origin))).mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    return parts.select("i", "j", ((F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("cov"))


@query("agg_26_covariance", "with p as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding::double[]) as x from embeddings) select a.i::int as i, b.i::int as j, round(covar_samp(a.x, b.x), 6) as cov from p a join p b on a.vec_id = b.vec_id and a.i <= b.i group by all")
def covariances(spark, folder):
    return covariance(table(spark, folder, "embeddings")).withColumn("cov", F.round("cov", 6))


@query("ml_6_projection")
def projection(spark, folder):
    """First two principal components of the embeddings."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, folder, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(rows)
    p = vector_to_array("p")
    return model.transform(rows).select("vec_id", "label", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))


@query("ml_1_linear_classifier")
def linear_classifier(spark, folder):
    """Binary classifier of label 0 against the rest; the counts of a confusion table."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, folder, "embeddings").select((F.col("label") == 0).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows)
    return model.transform(rows).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("ml_2_hidden_layer")
def hidden_layer(spark, folder):
    """Classifier with one hidden layer over all dimensions; held-out accuracy."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    width = rows.first().features.size
    model = MultilayerPerceptronClassifier(layers=[width, 6, 2], maxIter=30, seed=3).fit(rows.filter(~test))
    return model.transform(rows.filter(test)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"))


@query("ml_5_word_vectors")
def word_vectors(spark, folder):
    """Skip-gram vectors of synthetic sentences (an analogue: the reference trains a next-word softmax)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = sentences(spark, 400).select(F.array("a", "b", "c").alias("words"))
    vectors = Word2Vec(vectorSize=4, minCount=1, seed=5, inputCol="words", outputCol="v").fit(rows).getVectors()
    v = vector_to_array("vector")
    return vectors.select("word", *[F.round(v[i], 6).alias(f"v{i}") for i in range(4)])


@query("ml_3_features", "select l_orderkey, l_linenumber, round(l_quantity / 50.0, 6) as x, round(l_discount * 10, 6) as y, (l_returnflag = 'R')::int as label from lineitem")
def point_features(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 50.0, 6).alias("x"), F.round(F.col("l_discount") * 10, 6).alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def grid(low: float, high: float, steps: int, spark) -> DataFrame:
    """``x, y`` of a square of ``steps`` by ``steps`` points (of configuration size)."""
    one = spark.range(steps).select((F.lit(low) + F.col("id") * ((high - low) / (steps - 1) if steps > 1 else 0.0)).alias("v"))
    return one.select(F.col("v").alias("x")).join(F.broadcast(one.select(F.col("v").alias("y"))), how="cross")


@query("mth_5_grid", "select round(-1 + a * (2.0::double / 24), 9) as x, round(-1 + b * (2.0::double / 24), 9) as y from range(25) t(a), range(25) u(b)")
def grid_points(spark, folder):
    return grid(-1.0, 1.0, 25, spark).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("ml_4_boundary")
def boundary(spark, folder):
    """Probabilities of a model, trained on the points of ``src_16_rings``, over the cells of a grid."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = rings(spark, folder).select(F.col("label").cast("double").alias("label"), array_to_vector(F.array("x", "y")).alias("features"))
    model = MultilayerPerceptronClassifier(layers=[2, 8, 2], maxIter=60, seed=3).fit(points)
    cells = grid(-3.0, 3.0, 25, spark).withColumn("features", array_to_vector(F.array("x", "y")))
    return model.transform(cells).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round(vector_to_array("probability")[1], 6).alias("p"), F.col("prediction").cast("int").alias("label"))


@query("agg_27_bounds", "select label, round(min(x) - case when max(x) = min(x) then 1 else 0.1 * (max(x) - min(x)) end, 6) as low, round(max(x) + case when max(x) = min(x) then 1 else 0.1 * (max(x) - min(x)) end, 6) as high from (select label, embedding[1]::double as x from embeddings) group by 1")
def bounds(spark, folder):
    span = F.max("x") - F.min("x")
    pad = F.when(span == 0, 1.0).otherwise(0.1 * span)
    rows = table(spark, folder, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return rows.groupBy("label").agg(F.round(F.min("x") - pad, 6).alias("low"), F.round(F.max("x") + pad, 6).alias("high"))


_RIGHT_SQL = "select vec_id % 5 = 0 as test, label, (embedding[1] > 0) = (label % 2 = 1) as correct from embeddings"


@query("agg_28_gap", f"select label, round(abs(avg(case when not test then correct::int end) - avg(case when test then correct::int end)), 6) as gap from ({_RIGHT_SQL}) group by 1 having gap is not null")
def gap(spark, folder):
    """Distance of a rule's accuracy on training rows and on test rows; groups that lack either have none and are left out."""
    correct = ((F.col("embedding")[0] > 0) == (F.col("label") % 2 == 1)).cast("int")
    rows = table(spark, folder, "embeddings").select("label", (F.col("vec_id") % 5 == 0).alias("test"), correct.alias("correct"))
    accuracy = lambda test: F.avg(F.when(F.col("test") == test, F.col("correct")))
    return rows.groupBy("label").agg(F.round(F.abs(accuracy(False) - accuracy(True)), 6).alias("gap")).filter("gap is not null")


@query("agg_33_groups", "select label, count(*) as n, min(vec_id) as first from embeddings group by 1")
def groups(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


# --- losses ---------------------------------------------------------------------------------------------------------------------

# each embedding is read as the logits of one position, its label as the target
_LOGITS = "select vec_id, embedding::double[] as z, label % len(embedding) as target from embeddings"
_CE = "list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[target + 1]"


def log_sum_exp(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def logits(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn("z", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("target", (F.col("label") % F.size("z")).cast("int"))
    return rows.select("vec_id", "z", "target", (log_sum_exp(F.col("z")) - F.get("z", F.col("target"))).alias("loss"))


@query("mth_6_cross_entropy", f"select vec_id, round({_CE}, 6) as loss, round(exp({_CE}), 5) as perplexity from ({_LOGITS})")
def cross_entropy(spark, folder):
    return logits(spark, folder).select("vec_id", F.round("loss", 6).alias("loss"), F.round(F.exp("loss"), 5).alias("perplexity"))


@query("agg_29_masked_loss", f"select round(sum(case when target > 2 then {_CE} else 0 end) / count_if(target > 2), 6) as loss, count_if(target > 2)::bigint as tokens from ({_LOGITS})")
def masked_loss(spark, folder):
    mask = (F.col("target") > 2).cast("int")
    return logits(spark, folder).agg(F.round(F.sum(F.col("loss") * mask) / F.sum(mask), 6).alias("loss"), F.sum(mask).alias("tokens"))


@query("agg_30_chunked_loss", f"select round(sum(s) / sum(n), 6) as loss from (select vec_id // 32 as chunk, sum({_CE}) as s, count(*) as n from ({_LOGITS}) group by 1)")
def chunked_loss(spark, folder):
    chunks = logits(spark, folder).groupBy(F.floor(F.col("vec_id") / 32).alias("chunk")).agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    return chunks.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("loss"))


@query("sup_17_loss_difference", f"with c as (select vec_id, {_CE} as loss from ({_LOGITS})) select round((select avg(loss) from c), 6) as whole, round((select sum(s) / sum(n) from (select sum(loss) as s, count(*) as n from c group by vec_id // 32)), 6) as chunked, abs((select avg(loss) from c) - (select sum(s) / sum(n) from (select sum(loss) as s, count(*) as n from c group by vec_id // 32))) < 1e-5 as equal")
def loss_difference(spark, folder):
    """Mean loss over all positions and over chunks, and whether they agree."""
    whole = logits(spark, folder).agg(F.avg("loss").alias("whole"))
    return whole.join(chunked_loss(spark, folder).withColumnRenamed("loss", "chunked"), how="cross").select(F.round("whole", 6).alias("whole"), "chunked", (F.abs(F.col("whole") - F.col("chunked")) < 1e-5).alias("equal"))


@query("sup_16_mean_loss", f"select round(avg({_CE}), 6) as loss from ({_LOGITS})")
def mean_loss(spark, folder):
    return logits(spark, folder).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("agg_32_loss_by_batch", f"select vec_id // 64 as batch, round(sum({_CE}) / greatest(count(*), 1), 6) as loss from ({_LOGITS}) group by 1")
def loss_by_batch(spark, folder):
    return logits(spark, folder).groupBy(F.expr("vec_id div 64").alias("batch")).agg(F.round(F.sum("loss") / F.greatest(F.count("*"), F.lit(1)), 6).alias("loss"))


@query("agg_31_parameters", "select 64 * 256 * 2 + 256 * 256 * 4 as untied, 64 * 256 + 256 * 256 * 4 as tied, 64 * 256 as saved")
def parameters(spark, folder):
    shapes = spark.createDataFrame([("embed", 64, 256, 1), ("head", 64, 256, 1), ("attention", 256, 256, 4)], "name string, a int, b int, times int")
    size = F.col("a") * F.col("b") * F.col("times")
    saved = F.sum(F.when(F.col("name") == "head", size).otherwise(0))
    return shapes.agg(F.sum(size).cast("int").alias("untied"), (F.sum(size) - saved).cast("int").alias("tied"), saved.cast("int").alias("saved"))


# --- sequences of tokens ------------------------------------------------------------------------------------------------------------

_WORDS_SQL = "select doc_id, w, i from (select doc_id, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as i from documents where text is not null)"


def word_table(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "w"))


def arrays(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.split("text", " ", -1).alias("w"))


@query("win_17_next_word", f"select doc_id, i::int as i, w, lead(w, 1) over (partition by doc_id order by i) as next, lead(w, 2) over (partition by doc_id order by i) as after from ({_WORDS_SQL})")
def next_word(spark, folder):
    """Targets one and two steps ahead, from the array itself: no shuffle and no sort."""
    return arrays(spark, folder).select("doc_id", "w", F.posexplode("w").alias("i", "word")).select("doc_id", "i", F.col("word").alias("w"), F.get("w", F.col("i") + 1).alias("next"), F.get("w", F.col("i") + 2).alias("after"))


@query("win_18_targets", f"select doc_id, greatest(count(*) - 1, 0) as next_targets, greatest(count(*) - 2, 0) as after_targets from ({_WORDS_SQL}) group by 1")
def targets(spark, folder):
    n = F.size("w").cast("bigint")
    return arrays(spark, folder).select("doc_id", F.greatest(n - 1, F.lit(0)).alias("next_targets"), F.greatest(n - 2, F.lit(0)).alias("after_targets"))


@query("win_16_bigrams", f"select w as a, next as b, count(*) as n from (select w, lead(w) over (partition by doc_id order by i) as next from ({_WORDS_SQL})) where next is not null group by all")
def bigrams(spark, folder):
    pairs = F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b")))
    return arrays(spark, folder).select(pairs.alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("jon_19_word_index", f"with v as (select w, row_number() over (order by n desc, w) - 1 as place from (select w, count(*) as n from ({_WORDS_SQL}) group by 1)) select doc_id, i::int as i, place from ({_WORDS_SQL}) join v using (w)")
def word_index(spark, folder):
    """Place of each word of each document in the whole vocabulary (most frequent words first).

    Places are running counts over parts of (count, first characters), so no task orders the vocabulary.
    """
    words = word_table(spark, folder)
    counted = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("g", F.lit(0))
    part = F.struct(-F.col("n"), F.substring("w", 1, 2))
    vocabulary = running(counted.withColumn("less", -F.col("n")), ["g"], ["less", "w"], F.lit(1), part, "place").select("w", "place")
    return words.join(vocabulary, "w").select("doc_id", "i", "place")


@query("arr_2_concat", "select doc_id, array_to_string(list_concat(string_split(text, ' '), ['<eos>']), ' ') as joined from documents where text is not null")
def concat(spark, folder):
    return arrays(spark, folder).select("doc_id", F.array_join(F.concat("w", F.array(F.lit("<eos>"))), " ").alias("joined"))


@query("arr_3_truncated", "select doc_id, least(len(string_split(text, ' ')), 64)::int as n from documents where text is not null")
def truncated(spark, folder):
    return arrays(spark, folder).select("doc_id", F.size(F.slice("w", 1, 64)).alias("n"))


@query("arr_4_padded", "select doc_id, array_to_string(list_resize(string_split(text, ' '), greatest(256, len(string_split(text, ' '))), '<pad>'), ' ') as padded from documents where text is not null")
def padded(spark, folder, length: int = 256):
    """Texts shorter than ``length`` words get padding; longer ones stay as they are."""
    room = F.greatest(F.lit(length) - F.size("w"), F.lit(0))
    return arrays(spark, folder).select("doc_id", F.array_join(F.concat("w", F.array_repeat(F.lit("<pad>"), room)), " ").alias("padded"))


@query("arr_5_separated", "select doc_id // 64 as batch, string_agg(text, ' <sep> ' order by doc_id) as line from documents where text is not null group by 1")
def separated(spark, folder):
    """Whole texts of batches of 64 ids, in order, with a separator between them."""
    rows = table(spark, folder, "documents").filter("text is not null").select(F.expr("doc_id div 64").alias("batch"), "doc_id", "text")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "text")))  # at most 64 rows a batch
    return rows.groupBy("batch").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " <sep> ").alias("line"))


@query("arr_6_one_hot", "select vec_id, array_to_string(list_transform(range(10), lambda i: (i = label % 10)::int), '') as code from embeddings")
def one_hot(spark, folder):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label") % 10).cast("int"))
    return table(spark, folder, "embeddings").select("vec_id", F.array_join(hot, "").alias("code"))


@query("arr_7_flatten", "select shard_id, array_to_string(list_sort(list_distinct(flatten(list(parent_shard_ids)))), ',') as parents from shard_manifests where parent_shard_ids is not null group by 1")
def flatten(spark, folder):
    rows = table(spark, folder, "shard_manifests").filter("parent_shard_ids is not null").groupBy("shard_id").agg(F.collect_list("parent_shard_ids").alias("p"))
    return rows.select("shard_id", F.array_join(F.array_sort(F.array_distinct(F.flatten("p"))), ",").alias("parents"))


# --- synthetic sources and orders -------------------------------------------------------------------------------------------------------


@query("src_16_rings")
def rings(spark, folder, points: int = 1000, noise: float = 0.1, seed: int = 3):
    """Two noisy rings of radius 1 and 2.5."""
    label = (F.col("id") % 2).cast("int")
    angle = F.rand(seed) * (2 * 3.141592653589793)
    radius = F.when(label == 0, 1.0).otherwise(2.5)
    rows = spark.range(points).select(label.alias("label"), angle.alias("angle"), radius.alias("radius"), F.randn(seed + 1).alias("e1"), F.randn(seed + 2).alias("e2"))
    return rows.select((F.col("radius") * F.cos("angle") + noise * F.col("e1")).alias("x"), (F.col("radius") * F.sin("angle") + noise * F.col("e2")).alias("y"), "label")


def sentences(spark, n: int) -> DataFrame:
    """Synthetic three-word sentences; words by a hash of the row."""
    word = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    return spark.range(n).select("id", word(("cat", "dog", "fox", "owl"), 1).alias("a"), word(("eats", "likes", "sees"), 2).alias("b"), word(("apples", "grapes", "plums", "pears"), 3).alias("c"))


@query("src_17_sentences")
def synthetic_sentences(spark, folder):
    return sentences(spark, 500)


@query("src_18_crops")
def crops(spark, folder, batch: int = 16, length: int = 32, seed: int = 9):
    """Random crops of the token stream of each document that is long enough; offsets by a hash."""
    rows = arrays(spark, folder).filter(F.size("w") > length)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    start = F.pmod(F.xxhash64("doc_id", "b", F.lit(seed)), F.size("w") - length).cast("int")
    return rows.select("doc_id", "b", F.array_join(F.slice("w", start + 1, F.lit(length)), " ").alias("crop"))


@query("srt_10_split", "with d as (select doc_id, sha256(doc_id::varchar) as h from documents), t as (select doc_id, row_number() over (order by h, doc_id) as n from d where substring(h, 1, 2) >= '33') select d.doc_id, substring(h, 1, 2) < '33' as test, coalesce(n <= 20, false) as first_20, coalesce(n <= 200, false) as first_200, coalesce(n <= 2000, false) as first_2000 from d left join t using (doc_id)")
def split(spark, folder):
    """A permutation by hashes of ids: a fifth is for tests, and of the rest 20, 200 and 2,000 rows are nested prefixes.

    Only the longest prefix is ordered (a top-k); all other rows are told by their hash alone.
    """
    rows = table(spark, folder, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    test = F.substring("h", 1, 2) < "33"
    first = rows.filter(~test).orderBy("h", "doc_id").limit(2000).select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).alias("n"))
    marked = rows.join(F.broadcast(first), "doc_id", "left")
    return marked.select("doc_id", test.alias("test"), *[F.coalesce(F.col("n") <= k, F.lit(False)).alias(f"first_{k}") for k in (20, 200, 2000)])


@query("srt_7_limit", "select doc_id from documents order by doc_id limit 100")
def limit(spark, folder):
    return table(spark, folder, "documents").orderBy("doc_id").limit(100).select("doc_id")


@query(
    "srt_5_tied_argmax",
    f"with c as (select id, {_sql_counts('text')} from clean_records where text is not null) select id, {_DOMINANT_SQL} as dominant_script, {_TOTAL}::int as letters, ({' + '.join(f'({s} = {_MOST})::int' for s in T.SCRIPTS)})::int as tied from c where {_MOST} > 0",
)
def tied_argmax(spark, folder):
    """The script of most letters, at a tie the first in the order of the scripts, and how many share the place."""
    counts = T.script_counts(F.col("text"))
    most = F.greatest(*counts.values())
    tied = sum(((n == most).cast("int") for n in counts.values()), F.lit(0))
    rows = table(spark, folder, "clean_records").filter("text is not null").filter(most > 0)
    return rows.select("id", T.dominant(counts).alias("dominant_script"), sum(counts.values(), F.lit(0)).alias("letters"), tied.alias("tied"))


@query("str_26_absolute_links")
def absolute_links(spark, folder):
    """Addresses in texts with a scheme where they lack one."""
    urls = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?:)?//[^\s)]+"), 0)).alias("url"))
    return urls.select("doc_id", F.when(F.col("url").startswith("//"), F.concat(F.lit("https:"), "url")).otherwise(F.col("url")).alias("url"))


@query("sup_18_projected_words")
def projected(spark, folder):
    """Words with their category and the plane of their vectors' first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kinds = {"animal": ("cat", "dog", "fox", "owl"), "verb": ("eats", "likes", "sees"), "fruit": ("apples", "grapes", "plums", "pears")}
    category = F.create_map(*[F.lit(x) for kind, words in kinds.items() for w in words for x in (w, kind)])
    rows = word_vectors(spark, folder).select("word", array_to_vector(F.array(*[F.col(f"v{i}") for i in range(4)])).alias("features"))
    p = vector_to_array("p")
    return PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("word", category[F.col("word")].alias("category"), F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))


@query("sup_19_sample")
def sample_of_list(spark, folder):
    """One element of each list, chosen by a hash of the row."""
    rows = arrays(spark, folder).filter(F.size("w") > 0)
    return rows.select("doc_id", F.element_at("w", (F.pmod(F.xxhash64("doc_id"), F.size("w")) + 1).cast("int")).alias("w"))
