"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into lines, and a line after each sentence end 160 characters or more behind the last cut; each part, a
paragraph here, has a 60-bit digest. A sketch has three
tables of four cells; a digest is added to one cell of each, which hold how many digests they have, their xor and the
xor of their checks. Sketches subtract cell by cell, and what two versions share cancels out. A cell with one digest
left (a count of 1 or -1, and the check of its xor) gives that digest, which is taken out of its other cells, until
nothing is left: the difference is recovered. Where cells are left that hold several digests each, both versions are
sketched again eight times as large: the digests of the table are dealt by their next three bits to eight tables of 12
cells, and those are subtracted and peeled, and so on for the tables that fail still.

All of it is built of Spark's array functions, evaluated row by row within the stage that has the texts; nothing is
collected. The next document of each is found by dealing the table into ranges of doc_id by quantiles: the first row of
each range is dealt to the range before too, so that one exchange of the texts is all that moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm._frames import documents

#: 160 characters or more of a line up to the end of a sentence, or what a line has left.
PARAGRAPH = r"[^\x0A-\x0D]{160,}?[.!?]+[\x20\x09]+|[^\x0A-\x0D]+"
#: Tables of a sketch, and the bits that choose a cell in each.
TABLES, BITS = 3, 2
CELLS = TABLES << BITS
#: Bits of a digest, and those by which tables are split when they fail.
WIDTH, SPLIT = 60, 3
#: A failing table is split at most so often, past which digests differ in too few bits to tell apart.
LEVELS = (WIDTH - TABLES * BITS) // SPLIT
_HALF = (1 << WIDTH // 2) - 1
_ALL = (1 << WIDTH) - 1
#: Rows of a range of doc_ids, and how many ranges there are at most: a list of so many numbers is collected.
RANGE_ROWS, RANGES = 500, 65_536
_FIRST = -(1 << 63)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: the first 60 bits of their MD5."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.conv(F.substring(F.md5(p), 1, WIDTH // 4), 16, 10).cast("long")))


def _check(digest: Column) -> Column:
    """A product of the digest's halves: that of an xor isn't the xor of the checks."""
    return ((digest.bitwiseAND(F.lit(_HALF)) + F.lit(40_503)) * (F.shiftright(digest, WIDTH // 2) + F.lit(30_011))).bitwiseAND(F.lit(_ALL))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def _places() -> Column:
    """For each cell the bits of a digest that choose it, and what they must be."""
    mask = (1 << BITS) - 1
    return F.array(*(F.struct(F.lit(mask << t * BITS).cast("long").alias("mask"), F.lit(c << t * BITS).cast("long").alias("bits"))
                     for t in range(TABLES) for c in range(1 << BITS)))


def _checked(found: Column) -> Column:
    """Digests with their checks."""
    return F.transform(found, lambda x: F.struct(x.alias("key"), _check(x).alias("check")))


def _sketch(items: Column) -> Column:
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def cell(at: Column) -> Column:
        inside = F.filter(items, lambda x: x["key"].bitwiseAND(at["mask"]) == at["bits"])
        return F.reduce(inside, empty, lambda a, x: _cell(a["n"] + 1, a["key"].bitwiseXOR(x["key"]), a["check"].bitwiseXOR(x["check"])))
    return F.transform(_places(), cell)


def sketch(found: Column) -> Column:
    """12 cells of the digests ``found``: n, key and check of each."""
    return _let(_checked(found), _sketch)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def peel(cells: Column) -> Column:
    """The digests that a difference of sketches holds: here (count 1), there (count -1), and whether that is all."""
    def alone(x: Column) -> Column:
        return ((x["n"] == 1) | (x["n"] == -1)) & (x["check"] == _check(x["key"]))

    def without(out: Column):
        def cell(c: Column, at: Column) -> Column:
            inside = F.filter(out, lambda p: p["key"].bitwiseAND(at["mask"]) == at["bits"])
            return F.when(F.size(inside) == 0, c).otherwise(
                F.reduce(inside, c, lambda a, p: _cell(a["n"] - p["n"], a["key"].bitwiseXOR(p["key"]), a["check"].bitwiseXOR(p["check"]))))
        return cell

    def step(s: Column, _: Column) -> Column:
        def taken(out: Column) -> Column:
            return F.when(F.size(out) == 0, F.struct(s["cells"].alias("cells"), s["out"].alias("out"), F.lit(True).alias("over"))).otherwise(
                F.struct(F.zip_with(s["cells"], _places(), without(out)).alias("cells"), F.concat(s["out"], out).alias("out"), F.lit(False).alias("over")))
        return F.when(s["over"], s).otherwise(_let(F.array_distinct(F.filter(s["cells"], alone)), taken))
    start = F.struct(cells.alias("cells"), F.slice(cells, 1, 0).alias("out"), F.lit(False).alias("over"))

    def told(s: Column) -> Column:
        return F.struct(F.transform(F.filter(s["out"], lambda p: p["n"] == 1), lambda p: p["key"]).alias("here"),
                        F.transform(F.filter(s["out"], lambda p: p["n"] == -1), lambda p: p["key"]).alias("there"),
                        F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["key"] == 0)).alias("whole"))
    return _let(F.reduce(F.sequence(F.lit(1), F.lit(CELLS)), start, step), told)


def difference(a: Column, b: Column, sketch_a: Column | None = None, sketch_b: Column | None = None) -> Column:
    """The digests only in ``a`` (here) and only in ``b`` (there), from subtracted sketches that grow where they fail.

    The sketches of both may be given. Tables that fail when no bits are left to split them by are compared as lists."""
    def tried(t: Column) -> Column:
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), peel(subtract(_sketch(t["a"]), _sketch(t["b"]))).alias("got"))

    def split(x: Column, y: Column, level: Column) -> Column:
        shift = F.lit(WIDTH) - SPLIT * level
        parts = F.transform(F.array(*(F.lit(c).cast("long") for c in range(1 << SPLIT))), lambda c: F.struct(
            F.call_function("shiftleft", c, shift).alias("bits"), F.call_function("shiftleft", F.lit((1 << SPLIT) - 1).cast("long"), shift).alias("mask")))

        def part(side: Column, at: Column) -> Column:
            return F.filter(side, lambda p: p["key"].bitwiseAND(at["mask"]) == at["bits"])
        return F.transform(parts, lambda at: F.struct(part(x, at).alias("a"), part(y, at).alias("b")))

    def step(s: Column, level: Column) -> Column:
        def sorted_out(r: Column) -> Column:
            good = F.filter(r, lambda t: t["got"]["whole"])
            bad = F.filter(r, lambda t: ~t["got"]["whole"])
            return F.struct(F.flatten(F.transform(bad, lambda t: split(t["a"], t["b"], level))).alias("open"),
                            F.concat(s["here"], F.flatten(F.transform(good, lambda t: t["got"]["here"]))).alias("here"),
                            F.concat(s["there"], F.flatten(F.transform(good, lambda t: t["got"]["there"]))).alias("there"))
        return F.when(F.size(s["open"]) == 0, s).otherwise(_let(F.transform(s["open"], tried), sorted_out))

    def start(got: Column) -> Column:
        open_ = _let(F.struct(_checked(a).alias("a"), _checked(b).alias("b")), lambda t: split(t["a"], t["b"], F.lit(1)))
        none = F.slice(a, 1, 0)
        return F.when(got["whole"], F.struct(F.slice(open_, 1, 0).alias("open"), got["here"].alias("here"), got["there"].alias("there"))).otherwise(
            F.struct(open_.alias("open"), none.alias("here"), none.alias("there")))
    first = peel(subtract(sketch(a) if sketch_a is None else sketch_a, sketch(b) if sketch_b is None else sketch_b))

    def keys(x: Column, y: Column) -> Column:
        return F.array_except(F.transform(x, lambda p: p["key"]), F.transform(y, lambda p: p["key"]))

    def told(s: Column) -> Column:
        return F.struct(F.concat(s["here"], F.flatten(F.transform(s["open"], lambda t: keys(t["a"], t["b"])))).alias("here"),
                        F.concat(s["there"], F.flatten(F.transform(s["open"], lambda t: keys(t["b"], t["a"])))).alias("there"))
    return _let(F.reduce(F.sequence(F.lit(2), F.lit(LEVELS)), _let(first, start), step), told)


def likeness(a: Column, b: Column, sketch_a: Column | None = None, sketch_b: Column | None = None) -> Column:
    """The share of paragraphs two versions have in common: 1 without any difference (both empty too), 0 with nothing shared."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(difference(a, b, sketch_a, sketch_b), lambda d: (both - F.size(d["here"]) - F.size(d["there"])) / both))


def written(cells: Column) -> Column:
    """A sketch as text: 4, 15 and 15 hex digits a cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 15, "0"), F.lpad(F.hex(c["check"]), 15, "0"))), "")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, its paragraphs' digests, its sketch, and the columns of ``keep``. Null and blank texts: no digests,
    empty cells; a null text stays null. Repeated rows give repeated results; an empty table gives no rows; other columns
    don't matter. The count of a cell is that of distinct paragraphs, whatever the length of the text."""
    out = documents(docs, keep).withColumn("digests", digests(F.col("text"))).withColumn("sketch", sketch(F.col("digests")))
    return out.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def with_next(rows: DataFrame, *carry: str) -> DataFrame:
    """``rows`` (doc_id, text and others) with next: the columns of ``carry`` of the next row by doc_id, and of the first
    row for the last. Null doc_ids come first; rows with one doc_id are in order of their texts, nulls first."""
    order = F.coalesce("doc_id", F.lit(_FIRST))
    ids = rows.select(order.alias("k"))
    ranges = max(1, min(RANGES, ids.count() // RANGE_ROWS))
    at = ids.agg(F.percentile_approx("k", [i / ranges for i in range(ranges)], max(10_000, 4 * ranges))).first()[0]
    bounds = sorted(set(at or [_FIRST]))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    key = F.col("_key")
    place = F.reduce(steps, F.lit(0), lambda p, s: F.when(F.get(listed, p + s - 1) <= key, p + s).otherwise(p))
    first = F.get(listed, F.col("_range") - 1) == key
    before = F.when(F.col("_range") > 1, F.struct((F.col("_range") - 1).alias("range"), F.lit(False).alias("lap"), F.lit(True).alias("guest"))).otherwise(
        F.struct(F.lit(len(bounds)).alias("range"), F.lit(True).alias("lap"), F.lit(True).alias("guest")))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("lap"), F.lit(False).alias("guest"))
    dealt = (rows.withColumn("_key", order).withColumn("_range", place)
             .withColumn("_to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))))
    # a guest of a range comes after its own rows, which all have lesser keys, or a lap later
    following = Window.partitionBy("_to.range").orderBy("_to.lap", "_key", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return (dealt.withColumn("next", F.lead(F.struct(*carry)).over(following)).where(~F.col("_to.guest"))
            .drop("_key", "_range", "_to"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's sketch against those of an edited version and of the next document.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many of the next
    document's first code points, or all it has. Returns doc_id, n_chars, edited (text), digests, edited_digests,
    next_digests, sketch, edited_sketch, near_edited, near_next. Null texts count as empty; order and ties as in
    ``with_next`` (a lone document is its own next); an empty table gives no rows; other columns don't matter."""
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digests", digests(F.col("text")))
    n = F.length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    out = with_next(rows, "text", "digests").withColumn("n_chars", n).withColumn("edited", edited)
    out = out.select("doc_id", "n_chars", "edited", "digests", digests(F.col("edited")).alias("edited_digests"), F.col("next.digests").alias("next_digests"))
    out = out.select("*", sketch(F.col("digests")).alias("sketch"), sketch(F.col("edited_digests")).alias("edited_sketch"))
    own, changed, after = F.col("digests"), F.col("edited_digests"), F.col("next_digests")
    return out.select("*", likeness(own, changed, F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(own, after, F.col("sketch")).alias("near_next"))
