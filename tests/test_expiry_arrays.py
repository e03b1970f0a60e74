import random

import pandas as pd

from postlake.streaming import expiry as E


def plain(held, rows):
    """The same, a row at a time."""
    held, told = dict(held), []
    for i, seen, seq, due in sorted(rows):
        h = held.get(i)
        if h is not None and (seen, seq) <= h[:2]:
            continue
        if h is not None and due == h[2]:
            held[i] = (seen, seq, due, h[3])
            continue
        if h is not None and not h[3] and 0 <= h[2] < seen:
            told.append((i, h[2]))
        held[i] = (seen, seq, due, False)
    return held, sorted(told)


def test_a_bucket_of_postings_goes_on_as_each_posting_would():
    rng = random.Random(5)
    for _ in range(300):
        held, frame = {}, None
        for batch in range(3):
            rows = [(rng.choice("abcd"), rng.randrange(batch * 3, batch * 3 + 6), rng.randrange(3), rng.choice((-1, 1, 4, 7, 9))) for _ in range(rng.randrange(1, 12))]
            held, want = plain(held, rows)
            rng.shuffle(rows)
            frame, told = E.advanced(frame, pd.DataFrame(rows, columns=["id", "seen", "seq", "due"]))
            assert sorted(zip(told["id"], told["due"])) == want
            assert {r.id: (r.seen, r.seq, r.due, r.told) for r in frame.itertuples()} == held
            # Some are told by their timers between.
            frame["told"] |= (frame["due"] >= 0) & (frame["due"] < batch * 3)
            held = {i: (*h[:3], h[3] or 0 <= h[2] < batch * 3) for i, h in held.items()}
            frame = E.unpacked(E.packed(frame))


def test_python_is_called_for_buckets_and_not_for_postings(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) as id", "date'2026-01-01' as seen", "id as seq", "date'2026-01-05' as deadline")
    rows.unionByName(spark.sql("select 'x' as id, date'2026-03-01' as seen, 0L as seq, cast(null as date) as deadline")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = E.run_expiries(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), buckets=3)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1000
    assert query.recentProgress[0].stateOperators[0].numRowsTotal <= 3 * 3
