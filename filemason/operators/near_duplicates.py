"""Near duplicates by name words and size, perceptually similar images, and file similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from ..functions import text as X
from ..plans.actions import action_rows
from ..session import materialize
from . import pairing
from .ranking import rank_in_group

# Names listed in a review action; the whole group stays in the long table.
REVIEW_LIST = 1000
# Bounds that the search for the most similar files tries before its own.
TOP_BOUNDS = (0.95, 0.9)


def word_set(name: Column) -> Column:
    """Sorted distinct white-space words of a name; a blank name gets one empty word."""
    found = F.sort_array(F.array_distinct(X.words(name)))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def size_ratio(a: Column, b: Column) -> Column:
    """min/max of two sizes: 1 if both are zero, 0 if one is."""
    return (
        F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0))
        .otherwise(F.least(a, b) / F.greatest(a, b))
    )


def near_similarity(a: Column, b: Column) -> Column:
    """0.7 × Jaccard of name words + 0.3 × size ratio."""
    return 0.7 * X.jaccard(a["words"], b["words"]) + 0.3 * size_ratio(a["size"], b["size"])


def with_prefix_keys(nodes: DataFrame, min_jaccard: float, extra: list[Column] | None = None) -> DataFrame:
    """Add ``keys`` such that word sets with that Jaccard similarity (and equal ``extra`` values) share one.

    Sets of x and y words need an overlap of ``o = ceil(j / (1 + j) · (x + y))``, hence share one of the
    ``x - o + 1`` rarest words of the one and the ``y - o + 1`` rarest of the other when both order words
    alike. There is one key per such word and possible partner size, and the smaller set meets the larger
    one only. Frequent words hardly ever become keys.
    """
    words = nodes.select("seq", F.explode("item.words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    ranked = (
        words.join(counts, "word").groupBy("seq")
        .agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ranked"))
        .select("seq", F.transform("ranked", lambda x: x["word"]).alias("ranked"))
    )
    size, more = F.size("ranked"), extra or []
    partners = F.sequence(F.ceil(size * min_jaccard - 1e-9).cast("int"), F.floor(size / min_jaccard + 1e-9).cast("int"))

    def keys_for(other: Column) -> Column:
        overlap = F.ceil((size + other) * (min_jaccard / (1 + min_jaccard)) - 1e-9).cast("int")
        side = F.when(other == size, 0).when(size < other, 1).otherwise(2)
        return F.transform(F.slice("ranked", F.lit(1), F.greatest(size - overlap + 1, F.lit(0))), lambda w: F.struct(
            F.xxhash64(w, F.least(size, other), F.greatest(size, other), *more).alias("key"), side.alias("side")))

    return nodes.join(ranked, "seq").withColumn("keys", F.flatten(F.transform(partners, keys_for))).drop("ranked")


def with_size_windows(nodes: DataFrame, min_ratio: float) -> DataFrame:
    """Split each key by size: sizes at least that alike lie in the same or in adjacent bands of a logarithmic
    scale, so each key is issued for the two windows of bands that contain its size."""
    if min_ratio <= 0:
        return nodes
    size = F.col("item.size")
    band = F.when(size == 0, F.lit(-9)).otherwise(F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / min(min_ratio, 0.99)))))
    windows = F.array(band - 1, band)
    return nodes.withColumn("keys", F.flatten(F.transform("keys", lambda k: F.transform(windows, lambda w: F.struct(
        F.xxhash64(k["key"], w).alias("key"), k["side"].alias("side"))))))


def _near_profiles(files: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, pairing.Similar]:
    """Text files with their name words, profiles (equal words and size) with number and first file, profiles with
    blocking keys, and the test of two profiles."""
    if threshold <= 0.3:
        raise ValueError("at a threshold of 0.3 or less files without a common word could match")
    text = materialize(
        files.where(F.col("file_type").isin(V.TEXT_TYPES))
        .select("seq", "path", "name", "size", word_set(F.col("name")).alias("words")), "names")
    profiles = materialize(
        text.groupBy("words", "size").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
        .select("seq", "n", F.struct("words", "size").alias("item")), "profiles")

    def similar(a: Column, b: Column) -> Column:
        near = size_ratio(a["size"], b["size"]) * 0.3 + 0.7 >= threshold - 1e-9
        return near & (near_similarity(a, b) >= threshold)

    nodes = with_prefix_keys(profiles.drop("n"), (threshold - 0.3) / 0.7)
    return text, profiles, with_size_windows(nodes, (threshold - 0.7) / 0.3 - 1e-6), similar


def near_duplicate_pairs(files: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of near-duplicate text files: ``(seq_a, seq_b, n_a, n_b, similarity)`` with ``seq_a < seq_b``.

    A profile of equal name words and size, whose files are 1.0 alike, stands for all of them with their number and the first one's
    ``seq``, so copies aren't listed pair by pair.
    """
    _, profiles, nodes, similar = _near_profiles(files, threshold)
    pairs = pairing.similar_pairs(nodes, similar).select(
        F.col("lo").alias("seq_a"), F.col("hi").alias("seq_b"), near_similarity(F.col("lo_item"), F.col("hi_item")).alias("similarity"))
    number = lambda side: profiles.select(F.col("seq").alias(f"seq_{side}"), F.col("n").alias(f"n_{side}"))
    return pairs.join(number("a"), "seq_a").join(number("b"), "seq_b").select("seq_a", "seq_b", "n_a", "n_b", "similarity")


def near_duplicate_groups(files: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Groups of near-duplicate text files: ``(seed_seq, seq, path, name, similarity)``, seeds included.

    Files with the same words and size behave alike, so only the first of them takes part in pairing and
    the others follow it.
    """
    text, profiles, nodes, similar = _near_profiles(files, threshold)
    under = pairing.greedy_seeds(nodes, similar)
    placed = (
        profiles.join(under, "seq", "left")
        .select(F.col("seq").alias("profile_seq"), "n", "item", F.coalesce("seed", "seq").alias("seed_seq"))
    )
    seeds = placed.where("profile_seq = seed_seq").select("seed_seq", F.col("item").alias("seed_item"))
    counts = placed.groupBy("seed_seq").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    placed = placed.join(counts, "seed_seq").join(seeds, "seed_seq").select(
        "seed_seq", "group_size", F.col("item.words").alias("words"), F.col("item.size").alias("size"),
        near_similarity(F.col("seed_item"), F.col("item")).alias("similarity"))
    return text.join(placed, ["words", "size"]).select(
        "seed_seq", "group_size", "seq", "path", "name", "similarity")


def first_per_group(rows: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def review_actions(groups: DataFrame) -> DataFrame:
    """Review moves of near-duplicate groups, naming the members in order.

    A group has one action, for its seed; one of more than ``REVIEW_LIST`` members has another for each further so many, for the first
    of them, so that every member is named and no list grows without bound.
    """
    ranked = rank_in_group(groups, ["seed_seq"], "seq", "pos")
    part = F.floor((F.col("pos") - 1) / REVIEW_LIST)
    listed = ranked.groupBy("seed_seq", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "name", "path"))).alias("members"))
    names = F.array_join(F.transform("members", lambda m: m["name"]), ", ")
    more = F.when(F.col("part") > 0, F.concat(F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    reason = F.concat(F.lit("Similar to"), more, F.lit(": "), names)
    first = F.get("members", F.lit(0))
    return action_rows(
        listed, "move", seq=F.when(F.col("part") == 0, F.col("seed_seq")).otherwise(first["seq"]), source=first["path"],
        destination=F.lit("_Needs_Review/Similar_Files"), reason=reason, confidence=0.6,
        metadata=F.create_map(F.lit("similar_group"), F.transform("members", lambda m: m["path"])))


def hash_masks(n_hashes: int, threshold: int, bits: int = 64) -> list[int]:
    """Bit masks such that two hashes within ``threshold`` agree on at least one of them.

    The bits are cut into ``threshold + r`` pieces, of which at least ``r`` must agree; every choice of
    ``r`` pieces is one mask. More hashes call for a larger ``r``, that is longer and rarer keys.
    """
    from itertools import combinations

    wanted = max(1, n_hashes).bit_length()
    r = 1
    while r < 3 and r * bits // (threshold + r) < wanted:
        r += 1
    n = threshold + r
    edges = [bits * i // n for i in range(n + 1)]
    pieces = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    masks = [sum(chosen) for chosen in combinations(pieces, r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similar_hash_groups(hashes: DataFrame, threshold: int = 5) -> DataFrame:
    """Groups of images by hash ``(seed_seq, group_size, seq, distance)`` from ``(seq, hash)``, seeds included.

    Equal hashes are paired through their first image only.
    """
    hashes = materialize(hashes.select("seq", "hash").where(F.col("hash").isNotNull()), "hashes")
    distinct = materialize(hashes.groupBy("hash").agg(F.min("seq").alias("seq"), F.count("*").alias("n")), "distinct")
    masks = hash_masks(distinct.count(), threshold)
    keys = F.array(*[
        F.struct(F.xxhash64(F.lit(i), F.col("hash").bitwiseAND(F.lit(m).cast("bigint"))).alias("key"), F.lit(0).alias("side"))
        for i, m in enumerate(masks)])
    nodes = distinct.select("seq", F.struct("hash").alias("item"), keys.alias("keys"))
    under = pairing.greedy_seeds(nodes, lambda a, b: hamming(a["hash"], b["hash"]) <= threshold)
    placed = distinct.join(under, "seq", "left").select("hash", "n", "seq", F.coalesce("seed", "seq").alias("seed_seq"))
    seeds = placed.where("seq = seed_seq").select("seed_seq", F.col("hash").alias("seed_hash"))
    counts = placed.groupBy("seed_seq").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    placed = placed.drop("seq").join(counts, "seed_seq").join(seeds, "seed_seq")
    return hashes.join(placed, "hash").select(
        "seed_seq", "group_size", "seq", hamming(F.col("hash"), F.col("seed_hash")).alias("distance"))


def image_savings(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Per group of similar images: members, average size and the bytes that keeping one would save."""
    sized = groups.join(files.select("seq", "size"), "seq")
    return sized.groupBy("seed_seq").agg(
        F.count("*").alias("n_images"), F.avg("size").alias("avg_size"),
        (F.avg("size") * (F.count("*") - 1)).alias("wasted_bytes"))


def file_similarity(a: Column, b: Column) -> Column:
    """0.3 same type + 0.2 same extension + 0.3 name Jaccard + 0.1 size ratio + 0.1 closeness in time."""
    ratio = F.when((a["size"] > 0) & (b["size"] > 0), F.least(a["size"], b["size"]) / F.greatest(a["size"], b["size"]))
    apart = F.abs(F.unix_micros(a["modified_at"]) - F.unix_micros(b["modified_at"])) / F.lit(30 * 86400e6)
    return (
        F.when(a["file_type"] == b["file_type"], 0.3).otherwise(0.0)
        + F.when(a["extension"] == b["extension"], 0.2).otherwise(0.0)
        + X.jaccard(a["words"], b["words"]) * 0.3
        + F.coalesce(ratio, F.lit(0.0)) * 0.1
        + F.greatest(F.lit(0.0), 1 - apart) * 0.1
    )


def _file_profiles(files: DataFrame, min_sim: float) -> DataFrame:
    """``(seq, item)`` of files equal in name words, type, extension, size and time: the first one's ``seq``, and the number ``n``."""
    if min_sim <= 0.7:
        raise ValueError("at 0.7 or less files without a common name word could match")
    fields = ["words", "file_type", "extension", "size", "modified_at"]
    return materialize(
        files.select("seq", word_set(F.col("name")).alias("words"), *fields[1:])
        .groupBy(*fields).agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
        .select("seq", F.struct(*fields, "n").alias("item")), "profiles")


def similar_files(files: DataFrame, min_sim: float = 0.9) -> DataFrame:
    """Pairs of file profiles at least ``min_sim`` alike: ``(seq_a, seq_b, n_a, n_b, similarity)``.

    A profile stands for all files equal in name words, type, extension, size and time (which are 1.0
    alike); it carries their number and the first one's ``seq``. Above 0.7 a common name word is needed,
    above 0.8 the same extension as well, which is what the pairs are blocked by.
    """
    if min_sim <= 0.7:
        raise ValueError("at 0.7 or less files without a common word could match")
    fields = ["words", "file_type", "extension", "size", "modified_at"]
    profiles = materialize(
        files.select("seq", word_set(F.col("name")).alias("words"), *fields[1:])
        .groupBy(*fields).agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
        .select("seq", F.struct(*fields, "n").alias("item")), "profiles")
    extra = [F.col("item.extension")] if min_sim > 0.8 else None
    nodes = with_prefix_keys(profiles, (min_sim - 0.7) / 0.3, extra)
    pairs = pairing.similar_pairs(nodes, lambda a, b: file_similarity(a, b) >= min_sim)
    return pairs.select(
        F.col("lo").alias("seq_a"), F.col("hi").alias("seq_b"), F.col("lo_item.n").alias("n_a"),
        F.col("hi_item.n").alias("n_b"), file_similarity(F.col("lo_item"), F.col("hi_item")).alias("similarity"))


def most_similar_files(files: DataFrame, k: int = 5, min_sim: float = 0.8) -> DataFrame:
    """``(seq, rank, other, n, similarity)``: for each file profile its k most similar others at least ``min_sim`` alike.

    Profiles are those of ``similar_files``; ``n`` is the number of the other's files. Similarities count to nine digits, ties go to
    the smaller ``seq``. The bound falls in rounds: a profile with k others above a round's bound can't have a better one
    below it and is settled, so only what still lacks others meets by the more and commoner keys of a lower bound.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    profiles = _file_profiles(files, min_sim)
    opened = profiles.select("seq", F.lit(True).alias("open"))
    settled = []
    for bound in sorted({b for b in TOP_BOUNDS if b > min_sim} | {min_sim}, reverse=True):
        flagged = profiles.join(opened, "seq", "left").select(
            "seq", F.col("item").withField("open", F.coalesce("open", F.lit(False))).alias("item"))
        nodes = with_prefix_keys(flagged, (bound - 1e-9 - 0.7) / 0.3, [F.col("item.extension")] if bound > 0.8 + 1e-6 else None)
        found = materialize(pairing.most_similar(nodes, lambda a, b: F.round(file_similarity(a, b), 9), k, bound), "similar")
        if bound > min_sim:
            full = found.where(F.col("rank") == k).select("seq")
            opened = materialize(opened.join(full, "seq", "left_anti"), "open")
            found = found.join(full, "seq", "left_semi")
        settled.append(found)
    number = profiles.select(F.col("seq").alias("other"), F.col("item.n").alias("n"))
    return reduce(DataFrame.unionByName, settled).join(number, "other").select("seq", "rank", "other", "n", "similarity")
