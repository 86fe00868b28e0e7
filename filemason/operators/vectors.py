"""Feature vectors: metadata, name patterns, TF-IDF, images, scaling and projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log

from pyspark.ml.feature import (
    PCA, CountVectorizerModel, ElementwiseProduct, HashingTF, IDF, Normalizer, StandardScaler,
    VectorAssembler, VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..session import materialize
from .features import clustering_text


def metadata_columns(as_of: Column) -> dict[str, Column]:
    """The 23 numeric metadata features by name."""
    name = F.col("name")
    columns = {
        "log_size": F.log1p("size"),
        "age_days": P.days_between(as_of, F.col("modified_at")),
        "name_length": F.length(name),
        "underscore_count": X.count_of(name, "_"),
        "dash_count": X.count_of(name, "-"),
        "space_count": X.count_of(name, " "),
        "is_upper": X.is_upper(name),
        "is_lower": X.is_lower(name),
        "has_digits": X.has_digit(name),
        **{f"type_{t}": F.col("file_type") == t for t in V.FILE_TYPES},
        **{f"ext_{e}": F.col("extension") == e for e in V.ONE_HOT_EXTENSIONS},
    }
    return {n: c.cast("double") for n, c in columns.items()}


def common_name_words(files: DataFrame, min_frequency: int = 2, limit: int = 20) -> DataFrame:
    """Name words seen at least ``min_frequency`` times, the first ``limit`` by first appearance."""
    words = files.select("seq", F.posexplode(X.name_words(F.col("name"))).alias("pos", "word"))
    seen = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    return seen.where(F.col("n") >= min_frequency).orderBy("first").limit(limit).select("word", "n", "first")


def name_columns(words: Sequence[str]) -> dict[str, Column]:
    """Flags for corpus words in the name, and four date flags."""
    name = F.col("name")
    flags = {f"pattern_{i}": F.lower(name).contains(w) for i, w in enumerate(words)}
    flags |= {n: X.matches_any(name, [p]) for n, p in V.DATE_FLAGS.items()}
    return {n: c.cast("double") for n, c in flags.items()}


def name_pattern_columns(files: DataFrame) -> dict[str, Column]:
    words = [r["word"] for r in common_name_words(files).orderBy("first").collect()]
    return name_columns(words)


def long_form(files: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(seq, feature, value) rows."""
    cells = [F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in columns.items()]
    return files.select("seq", F.explode(F.array(*cells)).alias("cell")).select("seq", "cell.*")


def image_vector(image: Column) -> Column:
    """Eight numbers of an image feature struct; zeros when there is none."""
    def number(field: str, missing: float) -> Column:
        return F.coalesce(image[field].cast("double"), F.lit(missing))
    present = F.array(
        number("width", 0.0), number("height", 0.0), number("aspect_ratio", 1.0), number("total_pixels", 0.0),
        number("is_landscape", 0.0), number("is_portrait", 0.0), number("is_square", 0.0), number("has_exif", 0.0))
    return F.when(image.isNull(), F.array_repeat(F.lit(0.0), 8)).otherwise(present)


def term_words(text: Column) -> Column:
    """Lower-case words of a text without English stop words."""
    return F.filter(X.word_runs(text), lambda w: ~w.isin(V.ENGLISH_STOP_WORDS))


def _pairs(words: Column) -> Column:
    """Adjacent words as two-word terms."""
    joined = F.zip_with(words, F.slice(words, 2, 2**30), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_compact(joined)


def _words_and_pairs(rows: DataFrame) -> DataFrame:
    """``(seq, words, pairs)`` of ``(seq, words)``; a null word is in no pair."""
    return rows.select("seq", F.array_compact("words").alias("words"), _pairs(F.col("words")).alias("pairs"))


def _number(terms: DataFrame, column: Column) -> DataFrame:
    """``(term, n)`` of the terms in an array column. An outer explode: for a plain one the array would be made a second time, to see if it is empty."""
    return terms.select(F.explode_outer(column).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


def _frequent_terms(rows: DataFrame, single: DataFrame, wanted: int) -> tuple[list[str], DataFrame]:
    """The ``wanted`` most frequent one- and two-word terms, ties in term order, and ``(seq, terms)``, written, with at least the
    occurrences of these terms. ``single`` has the occurrences of each word.

    A pair occurs no more often than either of its words, so only pairs of words at least as frequent as
    the last wanted single word can be among them; the others are never made, counted or shuffled. Only where more than
    four times as many words are that frequent (in flat corpora), all pairs are counted, in a pass of their own.
    """
    order = [F.desc("n"), F.asc("term")]
    first = single.orderBy(*order).limit(wanted).collect()
    bounded, kept = True, rows
    if len(first) == wanted:
        common = [r["term"] for r in single.where(F.col("n") >= first[-1]["n"]).limit(4 * wanted + 1).collect()]
        bounded = len(common) <= 4 * wanted
        if bounded:
            kept = rows.select("seq", F.transform("words", lambda w: F.when(w.isin(common), w)).alias("words"))
    terms = _words_and_pairs(kept)
    if bounded:
        terms = materialize(terms, "terms")
    best = single.unionByName(_number(terms, F.col("pairs"))).orderBy(*order).limit(wanted)
    names = [r["term"] for r in best.collect()]
    every = F.coalesce(F.concat("words", "pairs"), F.array().cast("array<string>"))  # a null text has no terms
    if bounded:
        return names, terms.select("seq", every.alias("terms"))
    return names, materialize(terms.select("seq", F.filter(every, lambda t: t.isin(names)).alias("terms")), "terms")


def vocabulary(rows: DataFrame, max_features: int = 1000, max_df: float = 0.95) -> tuple[list[str], list[int], int, DataFrame | None]:
    """The most frequent terms of ``(seq, words)``, their document counts, the number of documents, and ``(seq, tf)``, vectors of the
    occurrences of these terms.

    Terms in more than ``max_df`` of the documents do not count. One pass over the texts counts all words, a second one writes the
    frequent ones and the pairs of these; everything else is counted in what was written.
    """
    n_docs = rows.count()
    single = materialize(_number(rows, F.col("words")), "words")
    wanted = max_features + 100
    while True:
        names, known = _frequent_terms(rows, single, wanted)
        if not names:
            return [], [], 0, None
        counts = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="tf").transform(known)
        counts = materialize(counts.select("seq", "tf"), "counts")
        held = counts.select(F.explode(F.unwrap_udt("tf")["indices"]).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
        documents = {r["at"]: r["n"] for r in held.collect()}
        kept = [i for i in range(len(names)) if documents[i] <= max_df * n_docs]
        if len(kept) >= max_features or len(names) < wanted:
            kept = kept[:max_features]
            if kept:
                sliced = VectorSlicer(inputCol="tf", outputCol="kept", indices=kept).transform(counts)
                counts = sliced.select("seq", F.col("kept").alias("tf"))
            return [names[i] for i in kept], [documents[i] for i in kept], n_docs, counts
        wanted *= 2


def tfidf(files: DataFrame, text: Column | None = None, max_features: int = 1000) -> tuple[DataFrame, list[str]]:
    """``(seq, tfidf)`` unit vectors with smooth IDF, and the terms of their positions. Texts are read twice."""
    text = clustering_text() if text is None else text
    rows = files.select("seq", term_words(text).alias("words"))
    names, documents, n, counts = vocabulary(rows, max_features)
    if not names:
        return rows.select("seq", F.lit(None).alias("tfidf")).limit(0), []
    weights = Vectors.dense([log((n + 1) / (df + 1)) + 1 for df in documents])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="tf", outputCol="weighted")
    normal = Normalizer(p=2.0, inputCol="weighted", outputCol="tfidf")
    return normal.transform(weighted.transform(counts)).select("seq", "tfidf"), names


def feature_matrix(files: DataFrame, as_of: Column, feature_types: Sequence[str] = ("text", "metadata", "name_similarity"),
                   max_features: int = 1000) -> tuple[DataFrame, list[str]]:
    """``(seq, features)`` vectors of the chosen kinds, and the feature names."""
    unknown = set(feature_types) - {"text", "metadata", "name_similarity"}
    if unknown:
        raise ValueError(f"unknown feature types: {sorted(unknown)}")
    columns: dict[str, Column] = {}
    if "metadata" in feature_types:
        columns |= metadata_columns(as_of)
    if "name_similarity" in feature_types:
        columns |= name_pattern_columns(files)
    inputs, names = [], []
    out = files.select("seq", *[F.array(*columns.values()).alias("numbers")] * bool(columns))
    if "text" in feature_types:
        text, term_names = tfidf(files, max_features=max_features)
        if term_names:
            out = out.join(text, "seq")
            inputs, names = ["tfidf"], [f"tfidf_{t}" for t in term_names]
    if columns:
        out = out.withColumn("numbers", array_to_vector("numbers"))
        inputs, names = [*inputs, "numbers"], [*names, *columns]
    if not inputs:
        return files.select("seq", array_to_vector(F.array().cast("array<double>")).alias("features")), []
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(out)
    return assembled.select("seq", "features"), names


def standardize(vectors: DataFrame, column: str = "features") -> DataFrame:
    """Zero mean and unit sample variance per dimension; constant dimensions become 0."""
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="scaled").fit(vectors)
    return scaler.transform(vectors).drop(column).withColumnRenamed("scaled", column)


def as_arrays(vectors: DataFrame, column: str = "features") -> DataFrame:
    return vectors.select("seq", vector_to_array(column).alias("vector"))


def project_2d(vectors: DataFrame, column: str = "features") -> tuple[DataFrame, list[float]]:
    """``(seq, x, y)`` on the first two principal components of standardised vectors, and the variance each
    explains. A component points to where its largest loading is positive."""
    size = len(vectors.select(vector_to_array(column).alias("v")).first()["v"])
    k = min(2, size)
    pca = PCA(k=k, inputCol=column, outputCol="pc").fit(vectors)
    loadings = pca.pc.toArray()
    signs = [1.0 if abs(loadings[:, i].max()) >= abs(loadings[:, i].min()) else -1.0 for i in range(k)]
    at = vector_to_array("pc")
    y = F.get(at, F.lit(1)) * signs[1] if k > 1 else F.lit(0.0)
    points = pca.transform(vectors).select("seq", (F.get(at, F.lit(0)) * signs[0]).alias("x"), y.alias("y"))
    return points, [float(v) for v in pca.explainedVariance.toArray()]


def hashed_embeddings(files: DataFrame, text: Column, dimensions: int = 256) -> DataFrame:
    """``(seq, embedding)`` unit vectors by hashed TF-IDF: the built-in embedding when no model is given."""
    rows = files.select("seq", X.word_runs(text).alias("words"))
    hashed = HashingTF(numFeatures=dimensions, inputCol="words", outputCol="tf").transform(rows)
    weighted = IDF(inputCol="tf", outputCol="weighted").fit(hashed).transform(hashed)
    normal = Normalizer(p=2.0, inputCol="weighted", outputCol="unit").transform(weighted)
    return normal.select("seq", vector_to_array("unit", "float32").alias("embedding"))


def model_embeddings(files: DataFrame, text: Column, make_predict: Callable[[], Callable], batch_size: int = 64) -> DataFrame:
    """``(seq, embedding)`` by a user's model: ``make_predict`` loads it once per worker and returns a function
    from a batch of texts to a matrix."""
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return files.select("seq", predict(text).alias("embedding"))
