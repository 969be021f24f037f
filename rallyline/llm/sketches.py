"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions alone.

A paragraph (line) has a 64-bit digest; a sketch adds each digest to one cell in each of three sub-tables, a cell being
a count, the digests' exclusive or and that of their check hashes.  Empty cells aren't stored.  A document's fingerprint
is its sketch, written out; the width of a sub-table is the power of two that its number of paragraphs asks for.

Two fingerprints subtract cell by cell, after the wider one is folded to the other's width, so common paragraphs vanish.
Peeling then takes a cell that holds one digest, notes it with its side, and removes it from its other cells until all
cells are empty.  Where that fails, both documents are sketched again at the width that all paragraphs of the two ask
for, and then at eight times that.  The likeness of two fingerprints is common / all paragraphs, from the two counts and
the number of digests recovered.

Building, subtracting and removing are one step, `gathered`: cells are put in order of place and those of one place are
added up, so each is n log n in the cells.

Defined results: null text counts as empty, which is one empty paragraph; repeated paragraphs count once; rows that
repeat both a doc_id and a text are one document; of other rows that repeat a doc_id each has a next one, in falling
order of their texts' hashes; a null doc_id is the smallest; a single document is its own next one; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.common import durable

#: Least width of a sub-table; widths tried after a failure, as multiples of what both documents' paragraphs ask for
#: together; rounds of a peeling.
LEAST, AGAIN, ROUNDS = 8, (1, 8), 24
#: A peeling is left out for the next width where over HOPELESS digests a cell differ (three places each peel up to 0.82),
#: or where over FULL of the cells are in use (0.92 at that load).
HOPELESS, FULL = 0.82, 0.95
#: What stands for a null doc_id in the order of ids.
FIRST = -(2**63)
#: Bits of an order's key that one step of the search for next documents settles, see successors.
STEPS = (12, 13, 13, 13, 13)
CELLS = "array<struct<p: bigint, n: int, x: bigint, c: bigint>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line)))


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit("check"), digest)


def cell(p: Column, n: Column, x: Column, c: Column) -> Column:
    return F.struct(p.cast("long").alias("p"), n.cast("int").alias("n"), x.alias("x"), c.alias("c"))


def width_for(n: Column) -> Column:
    """The least power of two that is LEAST and n at least."""
    bits = F.ceil(F.log2(F.greatest(n, F.lit(LEAST)).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def places(digest: Column, width: Column) -> list[Column]:
    """One in each sub-table, from 21 bits of the digest each; a place is 2^21 times the table's number and the cell."""
    low = width - 1
    return [F.shiftrightunsigned(digest, 21 * t).bitwiseAND(low) + (t << 21) for t in range(3)]


def gathered(cells: Column) -> Column:
    """Cells in order of place, those of one place added up and empty ones left out."""

    def runs(of: Column) -> Column:
        n = F.size(of)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(of, i - 1)["p"] != F.get(of, i - 2)["p"]))

        def add(a: Column, b: Column) -> Column:
            return F.struct(
                a["p"].alias("p"), (a["n"] + b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x"), a["c"].bitwiseXOR(b["c"]).alias("c")
            )

        def one(start: Column, stop: Column) -> Column:
            first = F.get(of, start - 1)  # most places have one cell
            return F.when(stop == start + 1, first).otherwise(F.aggregate(F.slice(of, start + 1, stop - start - 1), first, add))

        made = let(starts, lambda s: F.transform(s, lambda start, j: one(start, F.coalesce(F.get(s, j + 1), n + 1))))
        return F.filter(made, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))

    return F.when(F.size(cells) < 2, cells).otherwise(let(F.sort_array(cells), runs))


def entries(digest: Column, sign: Column, width: Column) -> Column:
    return let(check(digest), lambda c: F.array(*[cell(p, sign, digest, c) for p in places(digest, width)]))


def every(of: Column, sign: int, width: Column) -> Column:
    return F.flatten(F.transform(of, lambda d: entries(d, F.lit(sign), width)))


def sketch(of: Column, width: Column) -> Column:
    """Cells (p, n, x, c) of an array of distinct digests."""
    return gathered(every(of, 1, width))


def difference(of: Column, less: Column, width: Column) -> Column:
    """What subtracting the sketch of `less` from that of `of` gives, put in order once instead of three times."""
    return gathered(F.concat(every(of, 1, width), every(less, -1, width)))


def folded(cells: Column, width: Column) -> Column:
    """The cells of a sketch at a smaller width."""
    table = F.lit(-(1 << 21)).cast("long")
    return F.transform(cells, lambda k: cell(k["p"].bitwiseAND(table) + k["p"].bitwiseAND(width - 1), k["n"], k["x"], k["c"]))


def at_width(of: Column, width: Column) -> Column:
    """The cells of a (width, cells) at its own width or a smaller one."""
    return F.when(of["width"] == width, of["cells"]).otherwise(folded(of["cells"], width))


def subtract(a: Column, b: Column) -> Column:
    return gathered(F.concat(a, F.transform(b, lambda k: cell(k["p"], -k["n"], k["x"], k["c"]))))


def peel(cells: Column, width: Column) -> Column:
    """The digests (s, d) that a sketch holds, s their side (1 or -1); null where cells are left that hold no single one."""
    longs = lambda: F.array().cast("array<bigint>")

    def found(of: Column, sign: int) -> Column:  # plain longs: distinct structs would cost the square of their number
        single = F.filter(of, lambda k: (k["n"] == sign) & (check(k["x"]) == k["c"]))
        return F.array_distinct(F.transform(single, lambda k: k["x"]))

    def state(cells: Column, more: Column, less: Column, on: Column) -> Column:
        return F.struct(cells.alias("cells"), more.alias("more"), less.alias("less"), on.alias("on"))

    def step(at: Column, _: Column) -> Column:
        def without(new: Column) -> Column:
            left = gathered(F.concat(at["cells"], every(new["more"], -1, width), every(new["less"], 1, width)))
            return let(left, lambda c: state(c, F.concat(at["more"], new["more"]), F.concat(at["less"], new["less"]), F.size(c) > 0))

        new = F.struct(found(at["cells"], 1).alias("more"), found(at["cells"], -1).alias("less"))
        stuck = state(at["cells"], at["more"], at["less"], F.lit(False))
        more = let(new, lambda new: F.when(F.size(new["more"]) + F.size(new["less"]) == 0, stuck).otherwise(without(new)))
        return F.when(at["on"], more).otherwise(at)

    start = let(cells.cast(CELLS), lambda c: state(c, longs(), longs(), F.size(c) > 0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    told = lambda of, s: F.transform(of, lambda d: F.struct(F.lit(s).alias("s"), d.alias("d")))
    return let(end, lambda e: F.when(F.size(e["cells"]) == 0, F.concat(told(e["more"], 1), told(e["less"], -1))))


def with_difference(rows: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """Adds `out`: the digests in just one of two documents (s: 1 the first's, -1 the second's), by peeling.

    one and two name columns of `document`: the sketches that they hold are subtracted first.  What no width resolves is
    told digest by digest.
    """
    a, b = F.col(one), F.col(two)
    wide = width_for(F.size(a["digests"]) + F.size(b["digests"]))
    rows = rows.withColumn("_narrow", F.least(a["width"], b["width"]))
    room = F.col("_narrow") * 3
    # at least as many digests differ as the two counts do: with more than HOPELESS of the cells' number none peel
    may = F.abs(F.size(a["digests"]) - F.size(b["digests"])) <= room * HOPELESS
    rows = rows.withColumn("_cells", F.when(may, subtract(at_width(a, F.col("_narrow")), at_width(b, F.col("_narrow")))))
    rows = rows.withColumn(out, F.when(F.size("_cells") <= room * FULL, peel(F.col("_cells"), F.col("_narrow"))))
    for times in AGAIN:  # a step of its own for each, so that what isn't needed isn't made
        rows = rows.withColumn("_wide", F.least(wide * times, F.lit(1 << 21)))
        wider = peel(difference(a["digests"], b["digests"], F.col("_wide")), F.col("_wide"))
        rows = rows.withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(wider))
    side = lambda x, y, s: F.transform(F.array_except(x, y), lambda d: F.struct(F.lit(s).alias("s"), d.alias("d")))
    told = F.concat(side(a["digests"], b["digests"], 1), side(b["digests"], a["digests"], -1))
    return rows.withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(told)).drop("_narrow", "_wide", "_cells")


def with_likeness(rows: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """Adds `out`: common paragraphs / all paragraphs, from the counts and the recovered difference."""
    rows = with_difference(rows, one, two, out)
    both, d = F.size(F.col(one)["digests"]) + F.size(F.col(two)["digests"]), F.size(out)
    return rows.withColumn(out, (both - d) / (both + d))


def document(text: Column) -> Column:
    """(width, cells, digests) of a text."""

    def made(of: Column) -> Column:
        return let(width_for(F.size(of)), lambda w: F.struct(w.alias("width"), sketch(of, w).alias("cells"), of.alias("digests")))

    return let(digests(text), made)


def fingerprint(of: Column) -> Column:
    """A document's sketch as a string: width, then place:count:digests:checks of each cell; see parsed."""
    cells = F.transform(of["cells"], lambda k: F.concat_ws(":", k["p"], k["n"], F.hex(k["x"]), F.hex(k["c"])))
    return F.concat_ws(";", of["width"].cast("string"), F.array_join(cells, ";"))


def parsed(print_: Column) -> Column:
    """(width, cells) of a fingerprint, which subtract and peel take."""
    parts = F.split(print_, ";")
    number = lambda text: F.conv(text, 16, -10).cast("long")

    def one(part: Column) -> Column:
        return let(F.split(part, ":"), lambda f: cell(f[0].cast("long"), f[1].cast("int"), number(f[2]), number(f[3])))

    return let(parts, lambda s: F.struct(s[0].cast("long").alias("width"), F.transform(F.slice(s, 2, F.size(s)), one).alias("cells")))


def successors(keys: DataFrame) -> DataFrame:
    """Rows (k, h, next_k, next_h): of distinct pairs (k, h), the next one in falling order; the first after the last.

    The order is found by parts of the key's bits, from the lowest up: within an interval of keys each pair's next one is
    the one below; the interval's least pair is followed by the greatest one of the next interval that isn't empty,
    which the step above finds in the same way.  So no window holds more than 2^13 intervals (2^20 for one k), and
    nothing is gathered anywhere.
    """
    top = F.struct(F.col("k").alias("k"), F.col("h").alias("h"))
    # unsigned order, so that plain shifts keep it
    rows = keys.select(
        F.col("k").bitwiseXOR(F.lit(FIRST)).alias("u"), F.col("h").bitwiseXOR(F.lit(FIRST)).alias("v"), top.alias("hi"), top.alias("lo")
    )
    links: DataFrame | None = None

    def step(rows: DataFrame, group: list[Column], order: list[Column], names: list[str]) -> DataFrame:
        nonlocal links
        rows = rows.select("*", *[g.alias(f"g{i}") for i, g in enumerate(group)])
        by = [f"g{i}" for i in range(len(group))]
        down = Window.partitionBy(*by).orderBy(*order)
        found = rows.select("lo", F.lead("hi").over(down).alias("hi")).where("hi IS NOT NULL")
        links = found if links is None else links.unionByName(found)
        up = rows.groupBy(*by).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        return durable(up.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "hi", "lo"))

    v = F.shiftrightunsigned("v", 44)
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(FIRST)).desc()
    rows = step(rows, [F.col("u"), v], [unsigned("v")], ["u", "v"])
    rows = step(rows, [F.col("u")], [F.col("v").desc()], ["u"])
    for bits in STEPS:
        rows = step(rows, [F.shiftrightunsigned("u", bits)], [unsigned("u")], ["u"])
    ends = rows.select("lo", "hi")  # one row: all keys are one interval
    every = links.unionByName(ends)
    return every.select(F.col("lo.k").alias("k"), F.col("lo.h").alias("h"), F.col("hi.k").alias("next_k"), F.col("hi.h").alias("next_h"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, own, next_text, other): a document, and the next one in falling order of doc_id.

    own and other are their `document`.  Only ids and hashes take part in the search; a text moves to its number, and
    once more to the document before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("k"), F.xxhash64("text").alias("h"), "text")
    after = durable(successors(durable(rows.select("k", "h").distinct())))
    own = rows.join(after.hint("merge"), ["k", "h"])
    # the first row of each pair; told by lag, so that both uses of rows are one exchange
    same = Window.partitionBy("k", "h").orderBy("doc_id")
    other = rows.withColumn("again", F.lag(F.lit(True)).over(same)).where("again IS NULL")
    other = other.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    return own.join(other.hint("merge"), ["next_k", "next_h"]).select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the other's first as many, or all."""
    n = F.char_length(text)
    half = F.floor(n / F.lit(2)).cast("int")
    return F.concat(F.substring(text, 1, n - half), F.substring(other, 1, half))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        document(F.col("text")).alias("own"),
        document(F.col("edited")).alias("new"),
        document(F.col("next_text")).alias("other"),
    )
    rows = with_likeness(with_likeness(rows, "own", "new", "near_edited"), "own", "other", "near_next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def differing(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, and the paragraph digests that its text and the next one's don't share, by side."""
    rows = with_next(docs).select("doc_id", document(F.col("text")).alias("own"), document(F.col("next_text")).alias("other"))
    found = with_difference(rows, "own", "other", "d")
    of = lambda s: F.transform(F.filter("d", lambda k: k["s"] == s), lambda k: k["d"])
    return found.select("doc_id", of(1).alias("only_own"), of(-1).alias("only_next"))
