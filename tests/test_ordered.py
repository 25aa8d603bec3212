"""Ordered operators against straight simulations of their rules."""

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from callweave.operators import calls, control, roles, truncate, turns
from callweave.functions import rules


def _simulate_breaker(kinds, limit):
    fails, out = 0, []
    for i, k in enumerate(kinds):
        if k == "f":
            fails += 1
        elif k == "r":
            fails = 0
        out.append((i, k == "f" and fails >= limit))
        if out[-1][1]:
            break
    return out


def test_circuit_breaker(spark):
    rng = random.Random(5)
    runs = {r: [rng.choice("ffrn") for _ in range(rng.randint(1, 25))] for r in range(60)}
    df = spark.createDataFrame([(r, i, k) for r, kinds in runs.items() for i, k in enumerate(kinds)], "run_id long, seq long, kind string")
    got = {}
    for r in control.circuit_breaker(df, F.col("kind") == "f", F.col("kind") == "r").collect():
        got.setdefault(r.run_id, []).append((r.seq, r.tripped))
        if r.tripped:
            assert r.remaining == len(runs[r.run_id]) - 1 - r.seq
    for r, kinds in runs.items():
        assert sorted(got[r]) == _simulate_breaker(kinds, 3)


@pytest.mark.parametrize("seq", ["7 * i - 50", "TIMESTAMP_MICROS(i * i * i)", "lpad(CAST(i AS string), 4, '0')", "named_struct('_row', -3L, '_i', i, '_j', 1)", "CAST(i AS double) * 1e-9"])
def test_ranges_of_a_run_do_not_matter(spark, monkeypatch, seq):
    """Runs that are cut into many ranges give what whole runs give, whatever orders them."""
    rng = random.Random(11)
    rows = [(r if r else None, i, rng.choice("ffrn"), rng.choice([0.25, 0.5, -0.25, None])) for r in range(9) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "run_id long, i long, kind string, cost double").repartition(5).selectExpr("run_id", f"{seq} AS seq", "kind", "cost")

    def every():
        parts = [control.circuit_breaker(df, F.col("kind") == "f", F.col("kind") == "r", 4), control.budget_cutoff(df, "cost", 3.0), control.first_over(df, "cost", 2.0), control.stop_after(df, F.col("kind") == "r")]
        return [sorted((tuple(r) for r in p.collect()), key=str) for p in parts]

    whole = every()
    monkeypatch.setattr(control, "LONG", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert every() == whole and all(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_one_long_run_is_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(control, "LONG", 100)
    df = spark.range(2000).selectExpr("1 AS run_id", "id AS seq", "1L AS one").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of so few bytes are joined otherwise
    try:
        ranges, cut = control._cut(df, "run_id", "seq")
        sizes = [r["count"] for r in ranges.groupBy("_block").count().collect()]
        assert cut and len(sizes) >= 3 and max(sizes) < 1000
        assert control.running(df, {"n": (F.col("one"), "sum")}).where("n <> seq + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_budget_and_first_over(spark):
    df = spark.createDataFrame([(1, i, 0.25) for i in range(6)], "run_id long, seq long, cost double")
    kept = control.budget_cutoff(df, "cost", 1.0).orderBy("seq").collect()
    assert [(r.seq, r.spent, r.warned) for r in kept] == [(0, 0.25, False), (1, 0.5, False), (2, 0.75, False)]
    assert [r.seq for r in control.first_over(df, "cost", 0.5).collect()] == [1]
    assert [r.seq for r in control.stop_after(df, F.col("seq") == 2).orderBy("seq").collect()] == [0, 1, 2]


def test_provider_fallback(spark):
    rows = [(1, 0, 0, "a", "quota_exhausted"), (1, 0, 1, "b", "ok"), (1, 1, 0, "a", "ok"), (1, 1, 1, "b", "server_error"), (1, 2, 1, "b", "ok"), (1, 2, 2, "c", "ok")]
    got = control.first_success(spark.createDataFrame(rows, "run_id long, call_seq long, rank int, provider string, outcome string")).orderBy("call_seq").collect()
    assert [r.provider for r in got] == ["b", None, "b"]
    assert control.backoff_schedule() == [2.0, 4.0, 8.0] and control.backoff_schedule(2, 7) == [7.0, 7.0]


def test_http_wait():
    assert [control.http_wait(429, n) for n in range(3)] == [2.0, 4.0, None]
    assert control.http_wait(429, 0, 9) == 9.0 and control.http_wait(503, 1, 9) == 4.0
    assert control.http_wait(401, 0) is None and control.http_wait(404, 0) is None


# ---------------------------------------------------------------- words to lines


def _label(s):
    if not s:
        return "Speaker"
    parts = s.split("_")
    return f"Speaker {parts[1]}" if len(parts) == 2 and parts[1].isdigit() else s.replace("_", " ").title()


def _simulate_lines(words):
    import re

    counts, first = {}, {}
    for i, (_, s, t, _) in enumerate(words):
        if s:
            first.setdefault(s, i)
            if t == "word":
                counts[s] = counts.get(s, 0) + 1
    major = set(sorted(counts, key=lambda s: (-counts[s], first[s]))[:2])
    merged, last = {}, None
    if len(counts) > 2:
        for _, s, _, _ in words:
            if s in major:
                last = s
            elif s and s not in merged:
                merged[s] = last
        opening = next(s for _, s, _, _ in words if s in major)
        merged = {k: v or opening for k, v in merged.items()}
    lines, now, held, at = [], None, [], None
    hold = re.compile(rules.HOLD, re.I)

    def flush():
        if held:
            lines.append(f"{_label(now)}: {''.join(held).strip()}")
            held.clear()

    for text, s, t, start in words:
        who = merged.get(s, s)
        if t == "word" and start is not None:
            if at is not None and start - at >= 30:
                gap = start - at
                flush()
                mark = " — hold" if lines and hold.search(lines[-1]) else ""
                lines.append(f"[{int(gap) // 60}:{int(gap) % 60:02d} silence{mark}]")
            at = start
        if who and who != now:
            flush()
            now = who
        held.append(" " if t == "spacing" else text)
    flush()
    return lines


def test_lines_equal_a_simulation(spark):
    rng = random.Random(11)
    calls_, rows = {}, []
    for c in range(40):
        words, clock = [], 0.0
        for _ in range(rng.randint(1, 40)):
            clock += rng.choice([0.5, 2, 31, 75.5])
            words.append((rng.choice(["well", "hold on", "one moment", "yes"]), rng.choice(["speaker_0", "speaker_1", "speaker_2", "the_boss", None]), rng.choice(["word", "word", "spacing", "punctuation"]), rng.choice([clock, clock, None])))
        calls_[c] = words
        rows += [(c, i, *w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "call_id long, pos long, text string, speaker string, type string, start double")
    got = {}
    for r in turns.build_lines(df).orderBy("call_id", "line_no").collect():
        got.setdefault(r.call_id, []).append(r.line)
    for c, words in calls_.items():
        assert got[c] == _simulate_lines(words), c


def test_silence(spark):
    rows = [(1, i, "w", "s", "word", t) for i, t in enumerate([0.0, 0.5, 2.0, 40.0])] + [(1, 9, "w", "s", "spacing", 99.0), (2, 0, "w", "s", "word", None)]
    df = spark.createDataFrame(rows, "call_id long, pos long, text string, speaker string, type string, start double")
    [r] = turns.silence_stats(df).collect()
    assert (r.num_gaps, r.longest_gap_ms, r.num_gaps_over_30s, r.total_silence_ms, r.silence_pct) == (2, 38000, 1, 39500, 98.8)
    assert [tuple(g) for g in r.gap_locations] == [(2.0, 40.0, 38000), (0.5, 2.0, 1500)]


# ---------------------------------------------------------------- roles


@pytest.mark.parametrize(
    ("lines", "method", "labels"),
    [
        (["Speaker 0: hello?", "Speaker 1: my name is Ann"], "intro", "CA"),
        (["Speaker 0: my name is Bob", "Speaker 1: thank you for calling Northwind"], "company", "CA"),
        (["Speaker 0: I need a flight", "Speaker 1: sure"], "client_content", "CA"),
        (["Speaker 0: good day", "Speaker 1: good day"], "direction", "CA"),
        (["Speaker 0: alone"], "direction", "A"),
        (["Speaker 0: this call is being recorded", "Speaker 1: how can I help"], "intro", "CA"),
        (["Speaker 0: a", "Speaker 1: b", "Speaker 2: c", "Speaker 0: d", "Speaker 2: e", "Speaker 0: f", "Speaker 2: g"], "direction", "CCCCCCC"),
        (["no label", "[0:31 silence]"], None, ""),
    ],
)
def test_roles(spark, lines, method, labels):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "call_id long, line_no long, line string")
    got = roles.label_roles(df, companies=["northwind"]).orderBy("line_no").collect()
    assert {r.method for r in got} == {method}
    assert "".join(r.line[0] for r in got if r.line.startswith(("Agent: ", "Client: "))) == labels
    if method is None:
        assert [r.line for r in got] == lines


def test_a_minor_speaker_joins_the_one_before(spark):
    lines = ["Speaker 0: a", "Speaker 1: my name is Ann", "Speaker 2: x", "Speaker 1: b", "Speaker 0: c"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "call_id long, line_no long, line string")
    got = [r.line for r in roles.label_roles(df).orderBy("line_no").collect()]
    assert got == ["Client: a", "Agent: my name is Ann", "Agent: x", "Agent: b", "Client: c"]


# ---------------------------------------------------------------- truncation


def _simulate_cut(text, limit):
    tokens = lambda s: int(len(s.split()) * 1.8)
    if tokens(text) <= limit:
        return text
    budget = limit - 2 * tokens(rules.CUT_MARK)
    a, m = int(budget * 0.3), int(budget * 0.4)
    z = budget - a - m
    lines = text.split("\n")

    def prefix(ls, b):
        used, n = 0, 0
        for x in ls:
            if used + tokens(x) > b:
                break
            used, n = used + tokens(x), n + 1
        return n

    i, j = prefix(lines, a), len(lines) - prefix(lines[::-1], z)
    gap, kept, used = lines[i:j] if i < j else [], [], 0
    mid = len(gap) // 2
    for r in range(max(mid, len(gap) - mid - 1) + 1):
        for k in [mid] if r == 0 else [mid + r, mid - r]:
            if 0 <= k < len(gap) and used + tokens(gap[k]) <= m:
                kept.append(k)
                used += tokens(gap[k])
        if used >= m:
            break
    parts = ["\n".join(lines[:i]), rules.CUT_MARK]
    if kept:
        parts += ["\n".join(gap[k] for k in sorted(kept)), rules.CUT_MARK]
    return "".join([*parts, "\n".join(lines[j:])])


def test_truncation_equals_a_simulation(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join("w" for _ in range(rng.choice([0, 1, 1, 3, 12, 30]))) for _ in range(rng.randint(1, 120))) for _ in range(60)] + ["\n".join(["w"] * 560), "\n".join(["w"] * 600), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, transcript string")
    for limit in (100, 1000):
        for r in truncate.truncate(df, limit).collect():
            text = texts[r.id]
            assert (r.cut.text or "") == _simulate_cut(text or "", limit)
            assert r.cut.removed_tokens == r.cut.original_tokens - r.cut.final_tokens
            assert r.cut.truncated == (int(len((text or "").split()) * 1.8) > limit)


# ---------------------------------------------------------------- ranges


def test_ranges_are_halved():
    days = {date(2024, 1, d): 90 for d in range(1, 9)}
    count = lambda a, b: sum(n for d, n in days.items() if a <= d <= b)
    ranges, cut = calls.split_range(date(2024, 1, 1), date(2024, 1, 8), count)
    assert not cut and all(count(*r) < 200 for r in ranges)
    assert sum((b - a).days + 1 for a, b in ranges) == 8
    days[date(2024, 1, 3)] = 500
    assert calls.split_range(date(2024, 1, 1), date(2024, 1, 8), count)[1]


def test_middle_out_is_linear_and_equals_a_loop():
    rng = random.Random(3)
    for _ in range(300):
        costs, budget = [rng.randrange(0, 9) for _ in range(rng.randrange(0, 30))], rng.randrange(0, 60)
        spent, kept, mid, r = 0, [], len(costs) // 2, 0
        while costs and r <= len(costs) and not (r and spent >= budget):
            for i in [mid] if r == 0 else [mid + r, mid - r]:
                if 0 <= i < len(costs) and spent + costs[i] <= budget:
                    spent, kept = spent + costs[i], [*kept, i]
            r += 1
        assert truncate.middle_out(costs, budget) == sorted(kept)
    began = time.perf_counter()
    assert len(truncate.middle_out([1] * 400_000, 10**9)) == 400_000
    assert time.perf_counter() - began < 3
