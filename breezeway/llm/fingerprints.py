"""Bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k least distinct hashes of a set. The sketch of a
union is the k least of both sketches, so sketches of parts merge into that of the whole.
The share of the k least of a union that both sketches hold estimates the resemblance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.common import SALTS, let, positions, words
from breezeway.session import materialise

K, SHINGLE = 128, 5
#: Hashes are numbers from 0 below 2**HASH_BITS.
HASH_BITS = 48


def _pairs(a: Column, b: Column) -> Column:
    """Joint hash of the elements at each place, up to the end of the shorter array ``b``."""
    return F.zip_with(F.slice(a, 1, F.size(b)), b, lambda x, y: F.xxhash64(x, y))


def _from(a: Column, step: int) -> Column:
    return F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0)))


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of 5 words; of fewer words, of the whole sequence; none without words."""
    def of_words(h1: Column) -> Column:
        h2 = lambda: let(_from(h1, 1), lambda b: _pairs(h1, b))
        h5 = let(h2(), lambda x: let(let(_from(x, 2), lambda b: _pairs(x, b)),
                                     lambda y: let(_from(h1, 4), lambda b: _pairs(y, b))))
        return F.when(F.size(h1) >= SHINGLE, h5).when(F.size(h1) > 0, F.array(F.xxhash64(h1))).otherwise(
            F.array().cast("array<bigint>"))

    hashes = let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text's shingles; empty for a text without words and for null."""
    return bottom(shingle_hashes(text), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, then from the k-th hash."""
    full = F.lit((k - 1) * 2.0 ** HASH_BITS) / F.greatest(F.element_at(s, -1), F.lit(1)).cast("double")
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets; 1 if both are empty."""
    both = let(merged(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(
        (F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds; 1 if the first is empty."""
    union = let(merged(a, b, k), lambda u: distinct_count(u, k))
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def merge_by(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes of a hot key are dealt over SALTS tasks first; each keeps its k least.
    """
    hashes = parts.select(*keys, F.explode_outer(column).alias("_h")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    least = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(F.col("_h").asc_nulls_last()))
    some = hashes.dropDuplicates([*keys, "_h"]).withColumn("_n", least).where(F.col("_n") <= k)
    return some.groupBy(*keys).agg(bottom(F.collect_list("_h"), k).alias(column))


def text_of(s: Column) -> Column:
    """A sketch as text: each hash as 12 hexadecimal digits."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def _name(column: str) -> Column:
    """A key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _askers(docs: DataFrame) -> DataFrame:
    """key, asker, half: each key is the next one, in descending order, of its asker.

    ``half`` is half the length of the asker's text in code points, that of its longest
    text if rows share the key.
    """
    place = materialise(positions(docs.select("key"), "key"), "order")
    n = max(place.count(), 1)
    halves = docs.groupBy(F.col("key").alias("_key")).agg(
        F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2)).alias("half"))
    asking = place.join(halves, F.col("key").eqNullSafe(F.col("_key"))).select(
        F.col("key").alias("asker"), "half", F.pmod(F.col("position") - 1, F.lit(n)).alias("position"))
    return asking.join(place, "position").select("key", "asker", "half")


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited form has the last half of the code points (rounded down) replaced by as many
    from the start of the next document, or all it has. The next document has the largest
    smaller key, that of the smallest the largest of all; of rows that share a key it is
    the least text. Returns key, n_chars, edited (text), fingerprint, edited_fingerprint
    (text_of a sketch), near_edited, near_next. Null texts are empty; equal texts have
    equal fingerprints; a null key counts as larger than all. An empty table gives an empty one.
    """
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = materialise(_askers(plain).select(_name("key").alias("name"), _name("asker").alias("asker"), "half"), "askers")
    # Both sides read the same exchange: it has the same two columns for both, and plain
    # equality on the name keeps its partitioning.
    dealt = plain.select(_name("key").alias("name"), "text").repartition("name")
    kind = plain.schema["key"].dataType
    first = dealt.groupBy("name").agg(F.min("text").alias("text"))
    following = first.join(links, "name").select(
        "asker", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"), sketch(F.col("text"), k).alias("next"))
    joined = dealt.join(following, F.col("name") == F.col("asker"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    own = F.when(F.col("name") != "null", F.substring("name", 2, 1 << 30)).cast(kind).alias("key")
    rows = joined.select(own, "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next")
    both = F.struct(sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("edited"),
                    F.col("next").alias("next"))
    marks = let(both, lambda s: F.struct(
        text_of(s["own"]).alias("fingerprint"), text_of(s["edited"]).alias("edited_fingerprint"),
        resemblance(s["own"], s["edited"], k).alias("near_edited"), resemblance(s["own"], s["next"], k).alias("near_next")))
    return rows.select(F.col("key").alias(key), "n_chars", "edited", marks.alias("_marks")).select(
        key, "n_chars", "edited", "_marks.*")
