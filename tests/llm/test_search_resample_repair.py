"""Exact search, importance resampling and conversation repair against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import repair, resample, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- search ------------------------------------------------------------------------------------------------------


def best_by_hand(rows, every, k):
    """{query: [(score, id)]} of (id, vector) rows, with Python's whole numbers."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in ok]
    out = {}
    for q, a in whole:
        if q % every == 0:
            for i, b in whole:
                if i != q:
                    s = sum(x * y for x, y in zip(a, b, strict=False))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, s))
    return {q: sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k] for q, found in out.items()}


def found(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return dict(got)


@pytest.mark.parametrize("shard_rows,first_rows", [(8192, 512), (70, 16)])
def test_search_is_exact(spark, monkeypatch, shard_rows, first_rows):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=12)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 12) for i in range(30)]  # ties
    rows += [(1100, [0.0] * 12), (1101, [0.0] * 12), (1102, []), (1103, [-0.0005]), (1104, [1.0, 2.0])]
    rows += [(1200, None), (1201, [None] * 12), (1202, [float("nan")] * 12), (1203, [float("inf")] * 12), (None, [9.0] * 12)]
    rows += [(1300, rows[0][1])] * 3 + [(1301, [5.0] * 12), (1301, [-5.0] * 12)]  # repeats, and one id of two vectors
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "shard": F.lit(1)})
    assert found(search.top_k(d, F.col("vec_id") % 20 == 0, 4)) == best_by_hand(rows, 20, 4)
    # Pruning drops no row, whatever the blocks are.
    ids = np.arange(len(centres) * 50)
    x = (centres[ids % 6] + 0.05 * rng.normal(size=(len(ids), 12))).astype(np.float64)
    lists = [search.postings_of(np.arange(len(ids), dtype=np.int32), x[:, c]) for c in range(12)]
    monkeypatch.setattr(search, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(search, "NEXT_ROWS", 4 * first_rows)
    for q in range(0, 60, 7):
        whole = search.scaled(x) @ search.scaled(x[q])
        order = [i for i in np.lexsort((ids, -whole)) if i != q][:5]
        assert search.max_score(search.scaled(x[q]), q, lists, ids, 5) == [(int(whole[i]), int(i)) for i in order]


def test_search_of_large_values_few_rows_and_none(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [1e17, 1.0]), (3, [-1e17, 0.5]), (4, [1e-300, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = best_by_hand(rows, 100, 10)
    got = found(search.top_k(d, F.col("vec_id") % 100 == 0))
    assert [i for _, i in got[0]] == [i for _, i in exact[0]] == [1, 2, 4, 3]
    assert [s for s, _ in got[0]] == [max(-(2**63), min(2**63 - 1, s)) for s, _ in exact[0]]
    assert search.top_k(d.where("vec_id < 0"), F.lit(True)).count() == search.top_k(d, F.lit(False)).count() == 0
    few = spark.createDataFrame([(100, [1.0]), (7, None)], "vec_id long, embedding array<float>")
    assert search.top_k(few, F.col("vec_id") % 100 == 0).count() == 0


# ---- resampling --------------------------------------------------------------------------------------------------


def test_position_table_is_crc32():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    sizes = [1, 2, 3, 4, 5, 31, 32, 33, 63, 64, 65, 96, 97, 1000, 4096, 9999]
    starts = np.array([int(rng.integers(0, len(data) - n)) for n in sizes])
    ends = starts + sizes
    for pick in (slice(None), slice(0, 7)):
        assert resample.spans_crc(data, starts[pick], ends[pick]).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts[pick], ends[pick], strict=True)]


def by_hand(docs, target, most, buckets, least, percent):
    def features(text):
        w = WORD.findall((text or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = math.floor(Fraction(sum(map(gain, f)), len(f))) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = Counter()
    drawn = [(*x[:4], r + 1) for r, x in enumerate(fit[: percent * len(fit) // 100])]
    ranks.update(x[:4] for x in drawn)
    left = []
    for x in out:
        if ranks[x[:4]] > 0:
            ranks[x[:4]] -= 1
        else:
            left.append((*x[:4], None))
    return sorted(drawn + left, key=repr)


@pytest.mark.parametrize("most,piece", [(1, 1 << 21), (3, 1 << 21), (2, 300)])
def test_resample(spark, monkeypatch, most, piece):
    rng = random.Random(7)
    words = ["alpha", "BETA", "ÉÀ", "x1", "日本語", "y" * 70, "Z" * 33, "it's", "a-b", "\x00c"]
    text = lambda n: rng.choice([" ", "\n", ". "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "..."), (None, text(30)), (None, text(25)), (503, "q" * 5000), (504, text(3000))]
    docs += [(600, docs[3][1])] * 6 + [(601, text(30))] * 3  # rows that repeat
    target = [None, "", *(text(12) + " alpha" * 9 for _ in range(5))]
    d = spark.createDataFrame([(i, x, "s", 1) for i, x in docs], "doc_id long, text string, score string, n_features int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    monkeypatch.setattr(resample, "FEATURES", 50)
    got = sorted((tuple(r) for r in resample.resample(d, t, most=most, buckets=97, least_words=10, percent=30).collect()), key=repr)
    assert got == by_hand(docs, target, most, 97, 10, 30)
    # Slices decide nothing.
    monkeypatch.setattr(resample, "PIECE", piece)
    blobs = [(x or "").encode() for _, x in docs]
    count = Counter()
    for _, part in resample._pieces(__import__("pyarrow").array([x for _, x in docs])):
        for _, crc, _ in resample.text_features(part, most):
            count.update(crc.tolist())
    whole = Counter(c for _, crc, _ in resample.text_features(blobs, most) for c in crc.tolist())
    assert count == whole


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert resample.resample(none, one).count() == 0
    assert [(r.n_features, r["rank"]) for r in resample.resample(one, none).collect()] == [(30, None)]  # a tenth of one is none
    assert [r["rank"] for r in resample.resample(one, none, percent=100).collect()] == [1]


# ---- repair ------------------------------------------------------------------------------------------------------


def damaged_by_hand(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        out += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repaired_by_hand(turns):
    """(faults, illegal, cost, audit, lines) by trying all edits whose roles can still fit."""
    seen, faults = set(), []
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    fits = re.compile(r"(s?(ua)*u?)")
    best = []

    def go(i, inserted, cost, audit, lines, roles):
        if not fits.fullmatch(roles):
            return
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", roles):
                best.append((cost, audit, lines))
            if inserted == 2:
                return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, inserted + 1, cost + 2, audit + "I", [*lines, f"{role}:"], roles + role[0])
        if i < len(turns):
            (role, text), fault = turns[i], faults[i]
            go(i + 1, 0, cost + 3, audit + "D", lines, roles)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, 0, cost + more, audit + "K", [*lines, f"{role}:{text}"], roles + (role[:1] or "-"))
                for new in ("user", "assistant"):
                    go(i + 1, 0, cost + 2 + more, audit + "R", [*lines, f"{new}:{text}"], roles + new[0])

    go(0, 0, 0, "", [], "")
    cost, audit, lines = min(best, key=lambda b: b[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return Counter(faults), illegal, cost, audit, lines


def conversation(rng, c, n):
    texts = ["Fine.", "Fine.", "no end", " \t\n", "", None, "Why?\n ", "Ends! ", "日本。"]
    return [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("segment,composed", [(1024, 32), (3, 2)])
def test_repair(spark, monkeypatch, segment, composed):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "COMPOSED", composed)
    rng = random.Random(11)
    rows = [r for c in range(40) for r in conversation(rng, c, rng.randint(1, 6))] + conversation(rng, None, 5) + conversation(rng, 2**60 + 1, 7)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("clash"), "cost": F.lit(1)})
    after = sorted(damaged_by_hand(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert sorted(map(tuple, repair.damage(d).collect()), key=repr) == sorted(after, key=repr)
    planned, repaired = repair.repair(repair.damage(d))
    lines = defaultdict(list)
    for r in repaired.orderBy("pos", "nth").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    sha = {r.conv_id: r.sha256 for r in repair.digests(repaired).collect()}
    got = {r.conv_id: r for r in planned.collect()}
    assert set(got) == {r[0] for r in after}
    for c, r in got.items():
        turns = [x for x in after if x[0] == c]
        faults, illegal, cost, audit, want = repaired_by_hand([x[2:] for x in turns])
        known = {x[1] for x in turns if x[1] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), (c, turns)
        assert lines[c] == want, (c, turns, audit)
        assert sha.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(want).encode()).hexdigest()


def test_long_conversation_in_segments_is_that_in_one(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "open", f"{i}.", f"{i}"])) for i in range(1500)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    for segment in (4096, 64):
        monkeypatch.setattr(repair, "SEGMENT", segment)
        monkeypatch.setattr(repair, "COMPOSED", 5)
        planned, repaired = repair.repair(d)
        seen.append((planned.collect(), repair.digests(repaired).collect()))
    assert seen[0] == seen[1]
    assert sum(len(x) for x in re.findall("[KRD]+", seen[0][0][0].audit)) == 1500


def test_repair_query_of_dropped_rows_and_none(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    make = lambda rows, to: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{to}/conversations.parquet")
    make([(gone, 0, "user", "Hm."), (kept, 0, "user", "Hm.")], "a")
    make([], "b")
    empty = hashlib.sha256().hexdigest()
    got = {r.conv_id: r for r in repair.op13_conversation_repair(spark, f"{tmp_path}/a").collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert (got[kept].cost, got[kept].audit, got[kept].repaired_sha256) == (2, "KI", hashlib.sha256(b"user:Hm.\nassistant:").hexdigest())
    assert repair.op13_conversation_repair(spark, f"{tmp_path}/b").count() == 0
