"""Line deduplication by MinHash [native]: DataFrame functions only.

Lines are trimmed and lower-cased; empty ones are left alone.  A line's set holds its distinct shingles of
``WIDTH`` characters (a shorter line is one shingle).  Samples are taken of the shingles of as many bytes, which
agree with those of characters as well or better.  A line gives a row for every ``STEP`` shingles, whose
64-bit hashes are made in generated code.  Three overlapping lanes of a hash, with ``MASKS`` masks that start in
different eighths of a lane's range, are the permutations: the least masked value of a lane is one MinHash
sample.  The minima by line come from one aggregation whose map side already holds whole lines, and equal
lines meet there.

``BANDS``, triples with a sample of each lane, are the keys of buckets: a pair at the threshold shares none with
probability about 0.001.  Only the nodes of buckets that several share move on.  They carry their samples' lowest
bytes and the parities of ``WORDS`` x 64 cells, over which their shingles are dealt by hash: two lines differ in
at least as many shingles as in cells, a sure bound that leaves few pairs below the threshold.  The rest are verified
by exact Jaccard similarity of their shingles, links are joined by distributed union-find, and one line per
component stays: the first by (doc_id, line number).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.linking import deal, link, similar
from papyrine.llm.scratch import Scratch, kept_by

WIDTH = 8
#: Shingles of a line in one row.
STEP = 8
LANES = (0, 16, 32)
#: One mask in each eighth of the range of 32-bit numbers: sevenfold steps from an odd start.
MASKS = tuple(((i << 29) | (0x0B3F_5A7D * (7 * i + 1)) % (1 << 29)) - (1 << 31) for i in range(8))
SAMPLES = len(LANES) * len(MASKS)
#: Samples of the three lanes that make a band; two bands share one sample at most.
BANDS = tuple((i, 8 + (i + a) % 8, 16 + (i + b) % 8) for a, b in ((0, 0), (3, 5)) for i in range(8))
#: Equal samples below which a candidate is not verified: at 0.75 there are 18 with a standard deviation of 2.1.
LEAST_EQUAL = 11
#: Words of 64 cells in which the parities of a line's shingles are held.
WORDS = 16
#: Shingles of a line in one row of these parities: with more, generated code grows too long to be compiled well.
FEW = 4
#: Characters of a line whose shingles are taken from one slice, so that long lines cost what their length says.
SLICE = 64


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) for every line that is not blank; ``line`` is trimmed and lower-cased."""
    # lower-cased as a whole: that costs half of what it does line by line
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.lower(text_col), "\n", -1)).alias("line_no", "raw"))
    # only a line with such an end is trimmed, which reads every character of it
    codes, space = F.col("raw").cast("binary"), F.lit(b" ")
    ends = (F.substring(codes, 1, 1) <= space) | (F.substring(codes, -1, 1) <= space)
    trimmed = F.when(ends, F.btrim("raw", F.lit(" \t\n\r\x0b\x0c"))).otherwise(F.col("raw"))
    return lines.select("doc_id", "line_no", trimmed.alias("line")).where("line <> ''")


def _keyed(lines: DataFrame) -> DataFrame:
    """Lines with a 128-bit hash, by which equal lines are known, and a hash of their place."""
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "place": F.xxhash64("doc_id", "line_no")})


def signatures(lines: DataFrame) -> DataFrame:
    """(h1, h2, place, m0..): one row per distinct line, the hash of one of its places and its samples."""
    held = ["h1", "h2", "place"]
    last = F.greatest(F.octet_length("line") - WIDTH, F.lit(0)) + 1
    rows = lines.select(*held, F.col("line").cast("binary").alias("codes"), last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(STEP))).alias("at"))
    # past the end the last shingle is taken again, which changes no minimum
    hashes = [F.xxhash64(F.substring("codes", F.least(F.col("at") + k, F.col("last")), F.lit(WIDTH))).alias(f"x{k}") for k in range(STEP)]
    hashed = rows.select(*held, *hashes)
    lanes = [F.shiftright(F.shiftleft(f"x{k}", lane), 32).cast("int").alias(f"l{lane}_{k}") for lane in LANES for k in range(STEP)]
    laned = hashed.select(*held, *lanes)
    samples = []
    for lane in LANES:
        for mask in MASKS:
            low = F.least(*[F.col(f"l{lane}_{k}").bitwiseXOR(F.lit(mask)) for k in range(STEP)])
            samples.append(F.min(low).alias(f"m{len(samples)}"))
    return laned.groupBy("h1", "h2").agg(F.min("place").alias("place"), *samples)


def _shingles(line: Column) -> Column:
    """Array of the hashed shingles of a line, in order of place."""

    def starts(codes: Column, step: int) -> Column:
        return F.sequence(F.lit(1), F.greatest(F.octet_length(codes) - 4 * WIDTH, F.lit(0)) + 1, F.lit(4 * step))

    def hashed(part: Column) -> Column:
        return F.transform(starts(part, 1), lambda at: F.xxhash64(F.substring(part, at, F.lit(4 * WIDTH))))

    def sliced(codes: Column) -> Column:
        slices = F.transform(starts(codes, SLICE), lambda at: F.substring(codes, at, F.lit(4 * (SLICE + WIDTH - 1))))
        return F.flatten(F.transform(slices, hashed))

    # bound in a lambda, else a line would be encoded anew for every slice
    return F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), sliced))


def parities(texts: DataFrame, name: str = "p", half: bool = False) -> DataFrame:
    """(id, p0..): for every row (id, line), of which cells an odd number of its shingles fall in, repeats counted.

    With ``half`` only the shingles of one half of each cell are taken; those of the other half follow from both.
    """
    codes = texts.select("id", F.encode("line", "UTF-32").alias("codes"))
    last = F.greatest(F.floor(F.octet_length("codes") / 4) - WIDTH, F.lit(0)) + 1
    placed = codes.select("id", "codes", last.cast("int").alias("last"))
    rows = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(FEW))).alias("at"))
    at = [F.col("at") + k for k in range(FEW)]
    hashed = rows.select("id", *[F.when(at[k] <= F.col("last"), F.xxhash64(F.substring("codes", at[k] * 4 - 3, F.lit(4 * WIDTH)))).alias(f"x{k}") for k in range(FEW)])
    if half:
        hashed = hashed.select("id", *[F.when(F.col(f"x{k}").bitwiseAND(F.lit(1 << 40)) != 0, F.col(f"x{k}")).alias(f"x{k}") for k in range(FEW)])
    word = [F.col(f"x{k}").bitwiseAND(F.lit(WORDS - 1)).cast("int").alias(f"w{k}") for k in range(FEW)]
    cell = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(f"x{k}", 16).bitwiseAND(F.lit(63)).cast("int")).alias(f"c{k}") for k in range(FEW)]
    dealt = hashed.select("id", *word, *cell)
    none = F.lit(0).cast("bigint")
    odd = [reduce(Column.bitwiseXOR, [F.when(F.col(f"w{k}") == j, F.col(f"c{k}")).otherwise(none) for k in range(FEW)]) for j in range(WORDS)]
    return dealt.groupBy("id").agg(*[F.bit_xor(odd[j]).alias(f"{name}{j}") for j in range(WORDS)])


def _packed(samples: list[str]) -> Column:
    """Lowest bytes of eight samples in one long."""
    return reduce(add, [F.shiftleft(F.col(m).cast("bigint").bitwiseAND(F.lit(255)), 8 * i) if i else F.col(m).cast("bigint").bitwiseAND(F.lit(255)) for i, m in enumerate(samples)])


def _unequal(a: Column, b: Column) -> Column:
    """Number of bytes in which two longs differ."""
    found = a.bitwiseXOR(b)
    for by in (4, 2, 1):
        found = found.bitwiseOR(F.shiftrightunsigned(found, by))
    return F.bit_count(found.bitwiseAND(F.lit(0x0101_0101_0101_0101)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, line_no, keeper_doc, keeper_line, kept) for every line that is not blank.

    Equal and near-equal lines form components; ``keeper`` is the component's first line by (doc_id,
    line_no), nulls first.  Null texts and blank lines give no rows.  Rows that repeat an id give their
    lines each; of lines that agree in doc_id, line_no and component, each is kept if the keeper is.
    Lines are known by the hash of their text in every plan, so nothing hangs on the order of the input.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _keyed(split_lines(docs, id_col, text_col))
    # numbered as written: each node has one number from here on
    signed = scratch.table(signatures(lines).withColumn("id", F.monotonically_increasing_id()), "signatures")
    keys = [F.xxhash64(F.lit(k), *[f"m{i}" for i in band]) for k, band in enumerate(BANDS)]
    dealt = deal(signed.select("id", F.explode(F.array(*keys)).alias("key")), scratch, twos=True)
    ids = scratch.table(dealt[0].select("id").distinct(), "ids")
    near = scratch.table(kept_by(signed, ids, ["id"]), "near")
    scratch.drop(signed, ids)
    # repeated rows give a text several times
    where = ["h1", "h2", "place"]
    texts = kept_by(lines.select(*where, "line"), near.select("id", *where), where, "inner").select("id", "line")
    texts = texts.dropDuplicates(["id"]).withColumn("n", F.size(F.array_distinct(_shingles(F.col("line")))))
    texts = scratch.table(texts, "texts")
    sets = texts.select("id", "n", (F.greatest(F.char_length("line") - WIDTH, F.lit(0)) + 1 - F.col("n")).alias("repeats"))
    packs = [_packed([f"m{i}" for i in range(at, at + 8)]).alias(f"m{at // 8}") for at in range(0, SAMPLES, 8)]
    nodes = near.select("id", *packs).join(sets, "id").join(parities(texts), "id")
    nodes = scratch.table(nodes, "nodes")

    def halved(some: DataFrame) -> DataFrame:
        both = some.join(parities(texts.join(some.select("id"), "id", "left_semi"), "q", half=True), "id")
        return both.withColumns({f"p{j}": F.col(f"p{j}").bitwiseXOR(F.col(f"q{j}")) for j in range(WORDS)})

    def close(a: str, b: str, words: str = "p") -> Column:
        sizes = F.least(f"n{a}", f"n{b}") * 100 >= F.greatest(f"n{a}", f"n{b}") * percent
        unequal = reduce(add, [_unequal(F.col(f"m{i}{a}"), F.col(f"m{i}{b}")) for i in range(SAMPLES // 8)])
        cells = reduce(add, [F.bit_count(F.col(f"{w}{j}{a}").bitwiseXOR(F.col(f"{w}{j}{b}"))) for w in words for j in range(WORDS)])
        # a repeat may turn one cell, which says nothing of the sets
        differ = cells - F.col(f"repeats{a}") - F.col(f"repeats{b}")
        bound = differ * (100 + percent) <= (F.col(f"n{a}") + F.col(f"n{b}")) * (100 - percent)
        return sizes & bound & (unequal <= SAMPLES - LEAST_EQUAL)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("b", "tb", "nb"), "b").join(texts.toDF("a", "ta", "na"), "a")
        alike = similar(_shingles(F.col("ta")), _shingles(F.col("tb")), F.col("na") + F.col("nb"), percent)
        return scratch.table(both.where(alike).select("a", "b"), "links")

    _, label = link(nodes, close, verify, scratch, dealt, finer=(halved, lambda a, b: close(a, b, "pq")))
    scratch.drop(nodes)
    same = ["h1", "h2"]
    places = scratch.table(lines.select("doc_id", "line_no", *same), "places")
    first = scratch.table(places.groupBy(*same).agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "firsts")
    linked = near.select("id", *same).join(label.toDF("id", "component"), "id").select("component", *same).join(first, same)
    linked = scratch.table(linked, "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    keeper = first.join(linked.join(least, "component").select(*same, "least"), same, "left")
    keeper = scratch.table(keeper.select(*same, F.coalesce("least", "first").alias("keeper")), "keepers")
    return places.join(keeper, same).select(
        "doc_id",
        "line_no",
        F.col("keeper.doc_id").alias("keeper_doc"),
        F.col("keeper.line_no").alias("keeper_line"),
        (F.struct("doc_id", "line_no") == F.col("keeper")).alias("kept"),
    )


def keep_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of their texts; needs ids that are not null and unique."""
    found = dedup_lines(docs, id_col=id_col, text_col=text_col, percent=percent).where("not kept")
    dropped = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__drop"))
    rest = F.array_join(
        F.filter(F.split(text_col, "\n", -1), lambda x, i: F.coalesce(~F.array_contains("__drop", i), F.lit(True))), "\n"
    )
    joined = docs.join(dropped, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)
