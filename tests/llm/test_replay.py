import random
import zlib

from docgrain.llm import replay

from .helpers import TINY


def plain(rows):
    """The replay, turn by turn: (conv_id, turn, status, attempts, first_at, last_at, release_no, state) of each row."""
    talks = {}
    for conv, turn, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, zlib.crc32((text or "").encode()), turn))
    out = []
    for conv, turns in talks.items():
        found = []
        for p, (_, _, crc, turn) in enumerate(sorted(turns, key=lambda x: x[:3])):
            h = [zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) for k in range(9)]
            back = h[0] % 5
            parent = found[p - back] if 0 < back <= p else None
            if parent and parent[0] != "delivered":
                found.append(("blocked", 0, None, None, turn, p, crc))
                continue
            at = first = max(7 * p, parent[3] if parent else 0)
            for a in range(1, 7):
                if not (h[1] % 101 < 50 and (at < 7 * p + h[2] % 101 or h[a + 2] % 3 == 0)):
                    found.append(("delivered", a, first, at, turn, p, crc))
                    break
                if a == 6:
                    found.append(("dead", 6, first, at, turn, p, crc))
                at += 10 * 2 ** (a - 1)
        state, numbers = 0, {}
        for n, x in enumerate(sorted((x for x in found if x[0] == "delivered"), key=lambda x: (x[3], x[4] is not None, x[4] or 0, x[5])), 1):
            state += n * x[6]
            numbers[x[5]] = (n, state)
        out += [(conv, x[4], *x[:4], *numbers.get(x[5], (None, None))) for x in found]
    return sorted(out, key=str)


def got(found):
    names = ("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
    return sorted((tuple(int(r[n]) if n == "state" and r[n] is not None else r[n] for n in names) for r in found.collect()), key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(c, t, x, "x", 1, 2) for c, t, x in rows], "conv_id long, turn long, text string, part string, p int, segment int").repartition(parts)


def test_matches_turn_by_turn(spark):
    chance = random.Random(3)
    rows = [(c, t, f"text {c} {t}" if chance.random() < 0.9 else None) for c in range(60) for t in range(chance.randrange(1, 12))]
    assert got(replay.replay(frame(spark, rows))) == plain(rows)
    assert {r[2] for r in plain(rows)} == {"delivered", "dead", "blocked"}


def test_one_conversation_over_all_ranges(spark):
    """A conversation that holds most rows is numbered, folded and ranked over several ranges."""
    rows = [(7, 3 * t - 50, f"turn {t}") for t in range(3000)] + [(c, t, "") for c in range(200) for t in range(3) if c != 7]
    assert got(replay.replay(frame(spark, rows))) == plain(rows)
    cut = replay.segments(frame(spark, rows)).where("conv_id = 7")
    assert cut.groupBy("segment").count().agg({"count": "max"}).first()[0] < 400
    reached = cut.where("back > 0 AND p >= back").selectExpr("p - back AS q", "segment AS s").join(cut.selectExpr("p AS q", "segment AS of"), "q")
    assert reached.where("s <> of").count() == 0
    assert reached.count() > 1000


def test_odd_rows(spark):
    same = [(1, 4, "a"), (1, 4, "a"), (1, 4, "b"), (1, 4, None), (1, 5, "")]
    nulls = [(None, 0, "x"), (None, 1, "y"), (None, None, "z"), (2, None, "q"), (2, None, "q"), (-5, -1, "negative"), (3, 10**12, "long " * 200_000)]
    assert got(replay.replay(frame(spark, same + nulls))) == plain(same + nulls)
    many = [(1, 1, "copy")] * 400
    assert got(replay.replay(frame(spark, many))) == plain(many)
    assert replay.replay(frame(spark, [])).count() == 0


def test_tables(spark):
    turns = spark.read.parquet(f"{TINY}/conversations.parquet")
    assert got(replay.replay(turns)) == plain([(r.conv_id, r.turn, r.text) for r in turns.collect()])
