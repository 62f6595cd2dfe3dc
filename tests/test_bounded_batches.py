"""Arrow batches of whole texts stay small, and places in texts are looked up once."""

import random

from papyrine.functions import span_rules as R
from papyrine.operators import chunking, spans
from papyrine.sources.session import BATCH_BYTES, BATCH_ROWS

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_and_smaller_bounds_stay(spark):
    before = spark.conf.get(ROWS), spark.conf.get(BYTES)
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    try:
        for rows, size, want in (("10000", "67108864b", (BATCH_ROWS, BATCH_BYTES)), ("0", "9m", (BATCH_ROWS, BATCH_BYTES)), ("7", "1m", (7, 1 << 20))):
            spark.conf.set(ROWS, rows)
            spark.conf.set(BYTES, size)
            chunking.paragraph_chunks(docs, "doc_id", "text")
            got = spark.conf.get(ROWS), spark.conf.get(BYTES).rstrip("b").replace("1m", str(1 << 20))
            assert tuple(map(int, got)) == want
    finally:
        spark.conf.set(ROWS, before[0])
        spark.conf.set(BYTES, before[1])


def test_sentences_by_known_marks():
    def plain(text, start, end):
        begin = max(text.rfind(c, 0, start) for c in ".!?\n") + 1
        stops = [p for c in ".!?\n" if (p := text.find(c, end)) >= 0]
        return text[begin : min(stops) + 1 if stops else len(text)].strip()

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\né") for _ in range(rng.randint(0, 40)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        assert spans.sentence_at(text, start, end) == plain(text, start, end)


def test_patterns_are_left_out_only_where_they_cannot_match():
    rules = spans._compiled((*R.MENTIONS, *R.SUPPLEMENTS))
    parts = ["Fıgure 1", "FİG. 2", "Table S3", "tables S1, S2", "Dataſet 4", "ſupplementary File 2", "SI Appendix", "Supporting Information Table 1", "Additional 5", "Appendix B", "fig 1 in the supporting material", "https://x.y/suppl.csv", "nothing"]
    for text in ["", *parts, *map(str.upper, parts), " ".join(parts)]:
        kept = [p.pattern for _, p in spans.possible(text, rules)]
        assert {p.pattern for _, p in rules if p.search(text)} <= set(kept)
    assert spans.possible("nothing", rules) == []


def test_mentions_without_context_are_the_same_places(spark):
    texts = spark.createDataFrame([(1, "See Fig. 1A and Table S2. Data 3! SI Appendix"), (2, None)], "doc_id bigint, text string")
    whole, bare = spans.mentions(texts, "doc_id", "text"), spans.mentions(texts, "doc_id", "text", context=False)
    assert bare.columns == whole.columns[:-3]
    assert bare.collect() == whole.select(bare.columns).collect() and len(bare.collect()) == 4
