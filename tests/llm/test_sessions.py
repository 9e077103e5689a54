import random

import pytest

from inkstone.llm import sessions as S

EVENT = "user long, seconds long, batch long, value long"
NAMES = [c.split()[0] for c in S.VERSION.split(", ")]


def plain(events, gap=600):
    """Sessions anew after every batch."""
    out = {}
    for user in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == user), key=lambda e: e[1])
        for batch in sorted({e[2] for e in own}):
            now, groups = [e for e in own if e[2] <= batch], []
            for e in now:
                if groups and e[1] - groups[-1][-1][1] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                if new := sum(e[2] == batch for e in g):
                    old = [v for v in out.values() if v["user"] == user and v["retracted_batch"] is None and g[0][1] <= v["start_s"] and v["end_s"] <= g[-1][1]]
                    for v in old:
                        v["retracted_batch"], v["retracted_start_s"] = batch, g[0][1]
                    out[user, batch, g[0][1]] = dict(zip(NAMES, (user, batch, g[0][1], g[-1][1], len(g), new, len(old), sum(e[3] or 0 for e in g), None, None)))
    return sorted((tuple(v.values()) for v in out.values()), key=repr)


def found(spark, events, **options):
    return sorted((tuple(r) for r in S.versions(spark.createDataFrame(events, EVENT), **options).collect()), key=repr)


@pytest.mark.parametrize("seed,late,width,block", [(1, 0, 20_000, 1), (2, 3, 30_000, 1), (3, 3, 30_000, 4), (4, 9, 60_000, 2), (5, 3, 2_000_000, 1)])
def test_against_sessions_anew(spark, monkeypatch, seed, late, width, block):
    monkeypatch.setattr(S, "SPAN", 4)
    rng = random.Random(seed)
    events = []
    for _ in range(700):
        t = rng.randrange(-5000, width)
        events.append((rng.choice([1, 1, 1, 2, -3]), t, t // 900 + rng.choice([0, 0, 0, rng.randint(0, late)]), rng.choice([None, rng.randrange(1 << 32)])))
    assert found(spark, events, block=block) == plain(events)


def test_one_user_with_one_long_session(spark, monkeypatch):
    """A session over hundreds of chunks, closed by late events, and early ones too."""
    monkeypatch.setattr(S, "SPAN", 8)
    rng = random.Random(9)
    events = [(7, t, t // 900 + (rng.randint(-1, 3) if t % 7 == 0 else 0), t) for t in range(0, 400_000, 550) if rng.random() > 0.002]
    assert found(spark, events, block=2) == plain(events)
    assert len(found(spark, events, block=2)) >= 400


def test_merge_of_many_and_ties(spark):
    events = [(1, t, 0, 1) for t in range(0, 12_000, 1200)] * 2 + [(1, t, 20, 1) for t in range(600, 12_000, 1200)] + [(1, 600, 20, 5)]
    rows = found(spark, events)
    assert rows == plain(events)
    assert [r[6] for r in rows if r[1] == 20] == [10]


def test_gap_is_inclusive_and_edges(spark):
    assert [r[2:5] for r in found(spark, [(1, 0, 0, 1), (1, 600, 0, 1), (1, 1201, 0, 1)])] == [(0, 600, 2), (1201, 1201, 1)]
    broken = [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    assert found(spark, broken) == []
    assert found(spark, [*broken, (1, 5, 0, None)]) == [(1, 0, 5, 5, 1, 1, 0, 0, None, None)]
    odd = spark.createDataFrame([(1, 5, 0, 2, "x", 3)], EVENT + ", block string, n int")
    assert [tuple(r) for r in S.versions(odd).collect()] == [(1, 0, 5, 5, 1, 1, 0, 2, None, None)]


def test_turns_without_number_or_conversation(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, 2, "t"), (16, 0, "long " * 10_000), (16, 0, None)], "conv_id long, turn long, text string")
    rows = S.versions(S.conversation_events(df)).collect()
    assert len(rows) == 1 and rows[0].n_events == rows[0].n_new == 2 and rows[0].user in (4, 5)
    assert S.versions(S.conversation_events(df.limit(0))).collect() == []
