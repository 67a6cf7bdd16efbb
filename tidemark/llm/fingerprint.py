"""SimHash fingerprints by SQL functions only: weighted terms vote on the bits, permuted block tables find neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions
from tidemark.session import write_through

BITS = 128
#: A long holds the votes for four bits, 16 bits each; a part of a text has fewer terms than reach its sign.
LANES = 0x0001000100010001
PART = 32767
#: Bounds of slices that one search step passes over.
STRIDE = 64
#: Parts that the rows of one fingerprint are dealt to before they are counted and named.
SALTS = 64
#: Fingerprints of a bucket that are compared with as many others in one cell.
PART_OF_BUCKET = 4096
#: Of 128 bits, as many as 3 of 64.
RADIUS = 6


def term_hashes(text: str | Column) -> Column:
    """Hashes of a text's terms: each pair of neighbouring words, lower-cased; the ends pair with nothing.

    A term weighs as often as it occurs. An empty text has the one term of nothing.
    """
    words = F.split(F.lower(F.btrim(text, F.lit(" \t\n\r\f\v"))), r"\s+")
    return F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda a, b: F.xxhash64(a, b))


def with_fingerprint(texts: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """key, carried columns, hi, lo: the 128 bits of column `text` of each row; `key` must tell the rows apart.

    Terms are added up before anything is shuffled, a few sums per row and part. Carried columns must be numbers:
    with strings Spark would sort all terms instead of hashing them.
    """
    rows = texts.select(*key, *carried, F.posexplode(term_hashes(F.col("text"))).alias("at", "h"))
    rows = rows.withColumn("g", F.xxhash64("h"))
    votes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))).alias(f"{h}{j}") for h in "hg" for j in range(16)]
    parts = rows.groupBy(*key, F.floor(F.col("at") / PART).alias("part")).agg(
        F.count("*").alias("terms"), *[F.first(c).alias(c) for c in carried], *votes)
    wide = 0xFFFFFFFF
    pairs = [F.sum(F.shiftrightunsigned(f"{h}{j}", 16 * half).bitwiseAND(F.lit(0x0000FFFF0000FFFF))).alias(f"{h}{j}_{half}")
             for h in "hg" for j in range(16) for half in (0, 1)]
    total = parts.groupBy(*key).agg(F.sum("terms").alias("terms"), *[F.first(c).alias(c) for c in carried], *pairs)

    def word(h: str) -> Column:
        bits = []
        for j in range(16):
            for lane in range(4):
                count = F.shiftrightunsigned(f"{h}{j}_{lane % 2}", 32 * (lane // 2)).bitwiseAND(F.lit(wide))
                bit = 1 << (16 * lane + j)
                bits.append(F.when(count * 2 > F.col("terms"), F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return total.select(*key, *carried, word("h").alias("hi"), word("g").alias("lo"))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints, given by the prefixes of their columns."""
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def likeness(a: str, b: str) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def digest_parts(text: str) -> dict[str, Column]:
    """SHA-256 of a text as four longs."""
    digest = F.sha2(text, 256)
    return {f"sha{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}


def digest_hex() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))


def sliced(docs: DataFrame, slices: int) -> DataFrame:
    """`docs` (id, text) with `slice`: ranges of ids with about as many rows each, numbered from the largest ids on.

    An id that fills several ranges has its rows dealt to them by ranges of their text's hash.
    """
    points = F.array(*[F.lit(i / slices) for i in range(1, slices)]) if slices > 1 else F.array(F.lit(0.5))
    bounds = docs.agg(F.percentile_approx("id", points, F.lit(max(10_000, 20 * slices))).alias("bounds"))
    tops = F.filter("bounds", lambda b, i: i % STRIDE == STRIDE - 1)
    wide = F.array_distinct(F.filter("bounds", lambda b, i: (i > 0) & (F.get("bounds", i - 1) == b)))
    spans = F.map_from_arrays(wide, F.transform(wide, lambda x: F.size(F.filter("bounds", lambda b: b == x))))
    group = F.size(F.filter("tops", lambda b: b < F.col("id")))
    inside = F.size(F.filter(F.slice("bounds", F.col("group") * STRIDE + 1, STRIDE), lambda b: b < F.col("id")))
    share = 0.5 - F.xxhash64("text") / F.lit(2.0 ** 64)
    span = F.coalesce(F.try_element_at("spans", F.col("id")), F.lit(1))
    part = F.least(F.floor(share * span).cast("int"), span - 1)
    one_row = F.broadcast(bounds.withColumns({"tops": tops, "spans": spans}))
    return docs.crossJoin(one_row).withColumn("group", group).withColumn(
        "slice", F.lit(slices) - (F.col("group") * STRIDE + inside + part)).drop("bounds", "tops", "spans", "group")


def fingerprint_pairs(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Each row of `docs` with its fingerprint, that of its edited text, how like they and the next row's are, its links.

    The next row has the next smaller doc_id, after the last the first; rows of one id follow by a hash of their text,
    null ids come last. The edited text is the text with its last half (rounded down, in code points) replaced by as
    many of the first code points of the next row's, or all it has. Null texts count as empty, a single row is its own
    next one. Rows are dealt to slices by ranges of their ids, so a row finds the next one in its slice, and only
    the last of a slice takes the first text of the next; equal rows of one id are one slice. Fingerprints are written
    to the shared folder once, before each row's is compared with the next one's. Long texts are voted on in parts.

    class_id is the smallest doc_id with the same fingerprint (null if none has an id), links the number of other rows
    whose fingerprints differ in at most `radius` bits, copies included (see `near_pairs`).
    """
    slices = 4 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = sliced(rows, slices)
    order = Window.partitionBy("slice").orderBy(F.desc("id"), F.xxhash64("text"), "text")
    whole = Window.partitionBy("slice")
    placed = rows.withColumns({"n": F.row_number().over(order), "next_text": F.lead("text").over(order),
                               "last": F.count("*").over(whole)})
    heads = rows.groupBy("slice").agg(F.max("id").alias("id"))
    first = F.broadcast(heads)  # one row per slice
    texts = rows.join(first, ["slice", "id"]).groupBy("slice").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("head_text"))
    ring = Window.orderBy("slice")  # over slice numbers only, a few for each partition
    after_each = heads.select("slice", F.coalesce(F.lead("slice").over(ring), F.first("slice").over(ring)).alias("next_slice"))
    heads = after_each.join(texts.select(F.col("slice").alias("next_slice"), F.col("head_text").alias("head")), "next_slice")
    joined = placed.join(heads, "slice")
    at_end = F.col("n") == F.col("last")
    half = F.floor(F.length("text") / 2).cast("int")
    after = F.when(at_end, F.col("head")).otherwise(F.col("next_text"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(after, F.lit(1), half))
    pairs = joined.withColumn("edited", edited).select(
        "slice", "n", "doc_id", F.length("text").cast("long").alias("n_chars"),
        *[c.alias(k) for k, c in digest_parts("edited").items()],
        F.when(at_end, F.col("next_slice")).otherwise(F.col("slice")).alias("next_slice"),
        F.when(at_end, F.lit(1)).otherwise(F.col("n") + 1).alias("next_n"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("text")),
                          F.struct(F.lit(1).alias("e"), F.col("edited").alias("text")))).alias("v"))
    carried = ["doc_id", "n_chars", *[f"sha{i}" for i in range(4)], "next_slice", "next_n"]
    both = with_fingerprint(pairs.select("slice", "n", *carried, "v.e", "v.text"), ["slice", "n", "e"], carried)
    own = {f"{p}{w}": F.max(F.when(F.col("e") == e, F.col(w))) for p, e in (("", 0), ("edited_", 1)) for w in ("hi", "lo")}
    one = write_through(both.groupBy("slice", "n").agg(
        *[F.first(c).alias(c) for c in carried], *[c.alias(k) for k, c in own.items()]), "fingerprints")
    one = one.withColumn("salt", F.pmod(F.xxhash64("slice", "n"), F.lit(SALTS)))
    following = one.select(F.col("slice").alias("next_slice"), F.col("n").alias("next_n"), F.col("hi").alias("next_hi"),
                           F.col("lo").alias("next_lo"))
    named = link_counts(write_through(classes(one), "classes"), radius, blocks)
    named = named.select("hi", "lo", "class_id", "links", F.explode("salts").alias("salt"))
    followed = one.hint("merge").join(following, ["next_slice", "next_n"])
    return followed.hint("merge").join(named, ["hi", "lo", "salt"]).select(
        "doc_id", "n_chars", digest_hex().alias("edited_sha256"), as_hex("hi", "lo").alias("fingerprint"),
        as_hex("edited_hi", "edited_lo").alias("edited_fingerprint"), likeness("", "edited_").alias("near_edited"),
        likeness("", "next_").alias("near_next"), "class_id", "links")


def classes(fingerprints: DataFrame) -> DataFrame:
    """hi, lo, class_id, size, salts of each different fingerprint of `fingerprints` (doc_id, hi, lo, salt).

    class_id is the smallest doc_id of its rows, null if they have none; size counts them, salts lists those they have.
    Rows are counted by salt first, and joined back by salt, so a fingerprint of very many rows is no hot key.
    """
    parts = fingerprints.groupBy("hi", "lo", "salt").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    return parts.groupBy("hi", "lo").agg(F.min("class_id").alias("class_id"), F.sum("size").alias("size"),
                                         F.collect_set("salt").alias("salts"))


def near_pairs(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Each pair of `classes` (hi, lo, class_id, size) within the radius, once: these columns with a_ and b_, distance.

    Of `blocks` parts of the bits, two fingerprints within the radius share at least blocks - radius; each choice of so
    many is a table keyed by those bits. A bucket's rows are dealt to parts of about PART_OF_BUCKET, and each two parts
    are a cell of their own, whose distances are filtered inside the join. A pair counts in the first table it shares
    only, so pairs needn't be made distinct. The work for a bucket grows with the square of its different fingerprints.

    Both sides of the joins here and around grow with the input, so a hint has them shuffled: Spark takes a side for as
    large as its files before they are exploded, and would send 28 rows for each fingerprint through the driver.
    """
    blocks = blocks or radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    masks = [(signed(sum(c) >> 64), signed(sum(c) & (1 << 64) - 1)) for c in combinations(parts, blocks - radius)]
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.col("hi").bitwiseAND(hi), F.col("lo").bitwiseAND(lo)).alias("k"))
            for t, (hi, lo) in enumerate(masks)]
    kept = ["hi", "lo", "class_id", "size"]
    keyed = classes.select(*kept, F.explode(F.array(*keys)).alias("x")).select(*kept, "x.t", "x.k")
    full = keyed.groupBy("t", "k").count().where("count > 1").select(
        "t", "k", F.ceil(F.col("count") / PART_OF_BUCKET).alias("parts"))
    part = F.pmod(F.xxhash64("hi", "lo"), F.col("parts"))
    rows = write_through(keyed.hint("merge").join(full, ["t", "k"]).withColumn("part", part), "buckets")

    def side(name: str, others: Column, cell: tuple[str, str]) -> DataFrame:
        return rows.withColumn("other", F.explode(others)).select(
            "t", "k", F.col(cell[0]).alias("row"), F.col(cell[1]).alias("column"), *[F.col(c).alias(f"{name}_{c}") for c in kept])

    a = side("a", F.sequence(F.col("part"), F.col("parts") - 1), ("part", "other"))
    b = side("b", F.sequence(F.lit(0).cast("long"), F.col("part")), ("other", "part"))
    ahead = (F.col("a_hi") < F.col("b_hi")) | (F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo"))
    differing = [F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")) for w in ("hi", "lo")]
    shares = [differing[0].bitwiseAND(hi).bitwiseOR(differing[1].bitwiseAND(lo)) == 0 for hi, lo in masks]
    first = reduce(lambda c, ts: c.when(ts[1], F.lit(ts[0])), enumerate(shares[1:], 1), F.when(shares[0], F.lit(0)))
    met = ((F.col("row") < F.col("column")) | ahead) & (distance("a_", "b_") <= radius) & (first == F.col("t"))
    return a.hint("merge").join(b, ["t", "k", "row", "column"]).where(met).select(
        *[f"{n}_{c}" for n in "ab" for c in kept], distance("a_", "b_").alias("distance"))


def link_counts(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """`classes` with links: how many other rows, copies included, each of their rows is linked with."""
    ends = F.explode(F.array(*[F.struct(F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo"), F.col(f"{y}_size").alias("n"))
                               for x, y in ("ab", "ba")]))
    degrees = near_pairs(classes, radius, blocks).select(ends.alias("e")).groupBy("e.hi", "e.lo").agg(F.sum("e.n").alias("n"))
    return classes.hint("merge").join(degrees, ["hi", "lo"], "left").withColumn(
        "links", F.col("size") - 1 + F.coalesce("n", F.lit(0))).drop("n")
