"""The Patricia trie against a trie built node by node."""

import hashlib
import random
import zlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from vicinity.llm import queries, trie


def _nodes(paths):
    """Rows of the trie of (id, [(role, text)])."""
    members = {}
    for c, p in paths:
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    ends = {}
    for c, p in paths:
        ends.setdefault(tuple(p), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, m in members.items():
        below, todo = [], [k]
        while todo:
            below.append(todo.pop())
            todo += kids.get(below[-1], [])
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), sum(x not in kids for x in below), saved, digest))
    return sorted(out, key=str)


def _rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = []
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out.append((c, own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + v[h:]))
    return out


def _random(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        p = [("u", rng.choice(["", "a", "bb"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]
        if out and rng.random() < 0.5:
            p = list(rng.choice(out)[1])[: rng.randint(0, 9)] + p[: rng.randint(0, 2)]
        out.append((c * 37 % 5000 - 20, p))
    return out


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_nodes_of_random_sequences_in_any_number_of_ranges(spark, ranges):
    paths = _random(ranges or 0, 150)
    rows = [(c, None, None, None) for c, _ in paths] + [(c, i, role, text) for c, p in paths for i, (role, text) in enumerate(p)]
    turn, chars = trie.turn_columns(F.col("role"), F.col("text"))
    turns = spark.createDataFrame(rows, "id long, pos int, role string, text string").select("id", "pos", turn.alias("turn"), chars.alias("chars"))
    got = trie.prefix_trie(trie.gathered(turns), ranges)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _nodes(paths)


def test_ranges_of_sorted_paths_meet_in_the_same_points():
    """Every way to cut the sorted paths in three gives the points, parents and sums of one range."""
    rng = random.Random(4)
    for _ in range(60):
        paths = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 9))})
        wide = [b"".join(bytes(15) + bytes([c]) for c in p) for p in paths]
        chars = [[c - 96 + i for i, c in enumerate(p)] for p in paths]

        def merged(cuts, wide=wide, chars=chars):
            out = {}
            for a, b in zip([0, *cuts], [*cuts, len(wide)], strict=True):
                if a == b:
                    continue
                one = trie._Range()
                if a:
                    one.before(wide[a - 1])
                for i in range(a, b):
                    one.take(wide[i], chars[i], 2, i, f"e{i}")
                for row in one.finish(wide[b] if b < len(wide) else None):
                    out.setdefault(row[0], []).append(row)
            got = {}
            for k, rows in out.items():
                if any(r[2] for r in rows):
                    edge = max((r[10], r[12]) for r in rows if r[2])
                    up = max((r[10], r[11] or b"") for r in rows)
                    got[k] = (rows[0][1], sum(r[3] for r in rows), min(r[4] for r in rows if r[4] is not None), *(sum(r[j] for r in rows) for j in (5, 6, 7, 8)), rows[0][9], up, edge[1][up[0] - edge[0] :] if up[0] >= 0 else None, max((r[13] or "") for r in rows))
            return got

        whole = merged([])
        for i in range(len(wide) + 1):
            for j in range(i, len(wide) + 1):
                assert merged([i, j]) == whole


def test_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "ä😀"])) for c in [*range(0, 40), *range(100, 130), 205, 250] for t in range(rng.randint(1, 7))]
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 0, None, ""), (8, 0, "user", None), rows[3], rows[3], (None, 0, "user", "nobody"), (300, 1, "user", "x" * 90_000), *[(301, t, "user", str(t)) for t in range(400)], *[(c, 0, "user", "same") for c in range(400, 500)]]
    table = spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "conv_id long, turn long, role string, text string, name string, n int, path binary").repartition(3)
    want = _nodes(_rebuilt(rows))
    assert sorted((tuple(r) for r in trie.conversation_trie(table).collect()), key=str) == want
    assert sorted((tuple(r) for r in trie.conversation_trie(table, 9).collect()), key=str) == want
    assert trie.conversation_trie(table.where("false")).collect() == [] == trie.conversation_trie(table.where("conv_id is null")).collect()


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = trie.conversation_trie(spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_the_query_gives_the_rows_of_its_sql(spark, sf_dir):
    compare(spark, sf_dir, queries.op11_patricia_trie, queries.oracle_sql()["op11_patricia_trie"])
