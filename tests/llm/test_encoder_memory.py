"""What an encoder holds at once and remembers."""

import pyarrow as pa

from scoreloom.llm.stretches import StretchEncoder
from scoreloom.llm.token_files import LibraryCodec


def test_slices_are_small():
    """Six texts of 2 MB are worked on two at a time at most, and none is lost."""
    encoder = StretchEncoder(lambda text: list(text.encode()))
    counts = [count.tolist() for _, _, count in encoder.encoded(pa.array(["ab " * 699_000] * 6))]
    assert max(map(len, counts)) <= 2 and sum(map(len, counts)) == 6
    assert {n for c in counts for n in c} == {3 * 699_000}


def test_words_remembered():
    assert LibraryCodec.most <= 1 << 17


def test_rows_held(spark):
    """New values of 5,000 rows in one batch are held some 1,024 at a time."""
    from scoreloom.llm import common

    def make():
        alive = [0]

        class Counted(int):
            def __del__(self):
                alive[0] -= 1

        def one(text):
            alive[0] += 1
            return (Counted(alive[0]),)

        return one

    frame = spark.range(5000).coalesce(1).selectExpr("id AS doc_id", "'a' AS text")
    out = [r.held for r in common.map_rows(frame, ["doc_id"], make, "held bigint").collect()]
    assert len(out) == 5000 and max(out) <= 2 * common.ROWS
