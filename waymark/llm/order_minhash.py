"""Order MinHash fingerprints with DataFrame functions only.

A text's k-mers of words are numbered by occurrence (the second copy of a k-mer differs from
the first) and hashed onto a circle. For each of `points` evenly spaced points of the circle the
`size` next k-mers are taken, put back into text order, and the tuple is hashed. Each point
orders all k-mers by their distance from it, so it is a min-wise selection of its own, and every
tuple has `size` members unless the text has fewer k-mers. The order inside tuples makes the signature
follow edit distance rather than mere overlap. Likeness is the share of points whose tuples agree.

The points of one circle share a hash, which widens the spread of the likeness of texts with few k-mers. So texts of at
most `OWN` k-mers also have a tuple for each of `points` hash functions of their own: the `size` k-mers
that the function puts first, in text order. Two texts that both have these are compared by them alone, others by the circle.

Everything stays in array functions over one row, so a fingerprint needs no shuffle. A k-mer is
packed as 35 hash bits and 28 place bits in one long, which lets plain long arrays be sorted.

A word is a run of at most `PIECE` characters that are not blank, so a long run without blanks is
several words. Two marks stand before the text and two behind it, so a text of n words has n + 2
k-mers of three words, and one of a single word three. Null, empty and blank texts
have no k-mer and an empty fingerprint; two such texts have likeness 1, such a text and another
0. Equal texts always have equal fingerprints, repeated rows are rows of their own, an empty
table stays empty, and other columns stay as they are; helper columns are named after `out`, so
they clash with none that does not begin with it. Texts of up to 2**28 words are told apart by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, POINTS, TUPLE, PIECE = 3, 64, 2, 16
#: Texts of at most so many k-mers have hash functions of their own; from there on the circle's likeness spreads no wider.
OWN = 64
#: Ranges of ids that hold neighbours together; a power of two that is a square.
BLOCKS = 1024
_PLACE_BITS = 28
_PLACE_MASK = (1 << _PLACE_BITS) - 1


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - 63 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(place)


def with_signature(df: DataFrame, text: str, out: str, k: int = K, points: int = POINTS, size: int = TUPLE) -> DataFrame:
    """df with `out`: one long for each point (a power of two of them), the point in its upper and the tuple in its lower half; after them those of own functions, numbered on.

    Each step is a column of its own that the next one reads more than once, so that Spark
    evaluates it once and not inside the next step's lambda.
    """
    w, a, s, b, g = (f"__{out}_{x}" for x in ("words", "kmers", "starts", "numbered", "heads"))
    arc = 63 - (points - 1).bit_length()
    at = lambda name, i: F.get(F.col(name), i.cast("int"))
    none, mark = F.array().cast("array<bigint>"), F.array(*[F.lit(i).cast("bigint") for i in range(1, k)])
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn(w, F.transform(pieces, lambda x: F.xxhash64(x)))
    df = df.withColumn(w, F.when(F.size(w) == 0, none).otherwise(F.concat(mark, w, mark)))
    n_kmers = F.greatest(F.size(w) - (k - 1), F.lit(0))
    df = df.withColumn(a, F.sort_array(F.transform(F.slice(F.col(w), F.lit(1), n_kmers), lambda h, i: _packed(F.xxhash64(h, *[at(w, i + j) for j in range(1, k)]), i.cast("long")))))
    hash_of = lambda x: F.shiftright(x, _PLACE_BITS)
    df = df.withColumn(s, F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (hash_of(at(a, i)) != hash_of(at(a, i - 1))))))
    renumbered = F.flatten(
        F.transform(
            F.col(s),
            lambda i, j: F.transform(
                F.slice(F.col(a), i + 1, F.coalesce(at(s, j + 1), F.size(a)) - i),
                lambda x, o: F.when(o == 0, x).otherwise(_packed(F.xxhash64(hash_of(x), o), x.bitwiseAND(F.lit(_PLACE_MASK).cast("long")))),
            ),
        )
    )
    df = df.withColumn(b, F.when(F.size(s) == F.size(a), F.col(a)).otherwise(F.sort_array(renumbered)))
    # the first k-mer of every arc between two points; points whose arc is empty go on to the next one
    on_arc = lambda x: F.shiftright(x, arc).cast("int")
    places = F.when(F.size(b) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(b) - 1))
    df = df.withColumn(g, F.filter(places, lambda i: (i == 0) | (on_arc(at(b, i)) != on_arc(at(b, i - 1)))))

    def tuple_hash(i: Column) -> Column:
        # the next ones clockwise, round the circle
        own = F.slice(F.col(b), i + 1, F.lit(size))
        own = F.when(F.size(own) == size, own).otherwise(F.concat(own, F.slice(F.col(b), F.lit(1), F.least(F.lit(size), F.size(b)) - F.size(own))))
        return hash_in_order(own)

    def hash_in_order(own: Column) -> Column:
        in_order = F.sort_array(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_PLACE_MASK).cast("long")), 63 - _PLACE_BITS).bitwiseOR(hash_of(y))))
        hashes = F.transform(in_order, lambda z: z.bitwiseAND(F.lit((1 << (63 - _PLACE_BITS)) - 1).cast("long")))
        return F.shiftrightunsigned(F.xxhash64(hashes), 32)

    arc_of = lambda i: on_arc(at(b, i))
    tuples = F.transform(F.col(g), tuple_hash)
    # each point goes with the first head at or behind it; those behind the last head with the first head
    before = lambda j: F.coalesce(arc_of(at(g, j - 1)), F.lit(-1))
    dealt = F.flatten(F.zip_with(F.transform(F.col(g), lambda i, j: arc_of(i) - F.when(j == 0, -1).otherwise(before(j))), F.col(w), lambda n, h: F.array_repeat(h, n)))
    df = df.withColumn(w, tuples)
    rest = F.array_repeat(F.get(F.col(w), F.lit(0)), F.lit(points - 1) - F.coalesce(arc_of(F.element_at(F.col(g), -1)), F.lit(points - 1)))
    signature = F.when(F.size(g) == 0, none).otherwise(F.transform(F.concat(dealt, rest), lambda h, p: F.shiftleft(p.cast("long"), 32).bitwiseOR(h)))
    of_own = lambda i: F.sort_array(F.transform(F.col(b), lambda x: _packed(F.xxhash64(i, hash_of(x)), x.bitwiseAND(F.lit(_PLACE_MASK).cast("long")))))
    owned = F.transform(F.sequence(F.lit(points), F.lit(2 * points - 1)), lambda i: F.shiftleft(i.cast("long"), 32).bitwiseOR(hash_in_order(F.slice(of_own(i), F.lit(1), F.lit(size)))))
    short = (F.size(b) > 0) & (F.size(b) <= OWN)
    return df.withColumn(out, F.when(short, F.concat(signature, owned)).otherwise(signature)).drop(w, a, s, b, g)


def likeness(one: str, other: str, points: int = POINTS) -> Column:
    """The share of points with equal tuples, of own functions if both have them; 1 for two empty signatures, 0 for one of them."""
    both_short = (F.size(one) > points) & (F.size(other) > points)
    some = lambda c: F.when(both_short, F.slice(c, F.lit(points + 1), F.lit(points))).otherwise(F.slice(c, F.lit(1), F.lit(points)))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(some(F.col(one)), some(F.col(other)))) / F.lit(float(points)))


def as_text(signature: str) -> Column:
    """The tuples of the points in order as hexadecimal text, eight digits each."""
    return F.array_join(F.transform(F.col(signature), lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))), "")


def with_next(docs: DataFrame, key: str, carried: list[str], tie: Column) -> DataFrame:
    """docs with `next`, a struct of the carried columns of the row next in descending key, in a ring.

    Rows of equal keys are ordered by `tie`, a 64-bit hash. Rows are dealt into BLOCKS ranges of key
    and tie together, so a much repeated key is spread as well, each with a copy of the
    next range's first row: one shuffle and one window by range do, and no task sees the whole table.
    Only rows equal in both stay together; any order is right for them. Null keys stand
    at -2**52. An empty table stays empty; a column named `next` or `__next_…` is replaced.
    """
    side = int(BLOCKS**0.5)
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 52)))
    # descending place is ascending tie; rounding keeps the order of places
    place = k.cast("double") + (F.lit(0.5) - tie.cast("double") / float(1 << 64))
    keyed = docs.withColumns({"__next_key": k, "__next_tie": tie, "__next_place": place})
    bounds = docs.select(place.alias("p")).approxQuantile("p", [i / BLOCKS for i in range(1, BLOCKS)], 1 / (2 * BLOCKS)) or [0.0] * (BLOCKS - 1)
    cut = [*bounds, float("inf")]
    # the block is found in two steps of `side` comparisons each
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x < F.col("__next_place")))
    keyed = keyed.withColumn("__next_coarse", below(doubles(cut[side - 1 :: side])))
    fine = F.get(F.array(*[doubles(cut[i : i + side]) for i in range(0, BLOCKS, side)]), F.col("__next_coarse"))
    keyed = keyed.withColumn("__next_block", F.col("__next_coarse") * side + below(fine))
    # at most BLOCKS rows: the first row of each block stands at the end of the block before it
    first = keyed.groupBy("__next_block").agg(F.max(F.struct("__next_key", F.bitwise_not("__next_tie").alias("t"))).alias("first")).select("__next_block", F.xxhash64("first.__next_key", F.bitwise_not("first.t")).alias("first")).orderBy(F.desc("__next_block")).collect()
    before = {r["first"]: first[i - 1]["__next_block"] for i, r in enumerate(first)}
    halo = F.lit(None).cast("int")
    if before:
        halo = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.xxhash64("__next_key", "__next_tie"))
    copies = F.filter(F.array(F.struct(F.col("__next_block").alias("block"), F.lit(False).alias("halo")), F.struct(halo.alias("block"), F.lit(True).alias("halo"))), lambda x: x.block.isNotNull())
    order = Window.partitionBy("__next_at.block").orderBy("__next_at.halo", F.desc("__next_key"), "__next_tie")
    return (
        keyed.withColumn("__next_at", F.explode(copies))
        .withColumn("next", F.lead(F.struct(*carried)).over(order))
        .where(~F.col("__next_at.halo"))
        .drop("__next_at", "__next_key", "__next_tie", "__next_place", "__next_block", "__next_coarse")
    )
