import json
import random

import pandas as pd
from pyspark.sql import functions as F

from quarrylane.streaming import progress


def loop(events):
    """The fold as a loop over one key's events in order."""
    status = "pending"
    for stage, result in events:
        if stage in progress.OVERWRITES:
            status = progress.OVERWRITES[stage]
        elif stage in progress.YIELDS:
            status = status if status in progress.TERMINAL else progress.YIELDS[stage]
        elif stage == "source_complete":
            status = progress.COMPLETIONS.get(result, "complete")
        elif result == "error":
            status = "error"
    return status


def test_fold_equals_the_loop(spark):
    rng = random.Random(1)
    stages = [*progress.OVERWRITES, *progress.YIELDS, "source_complete", "note"]
    keys = {k: [(rng.choice(stages), rng.choice(["error", "success", "partial_success", "no_available_data", None, "ok"])) for _ in range(rng.randint(1, 7))] for k in range(300)}
    rows = [(k, i, s, r) for k, events in keys.items() for i, (s, r) in enumerate(events)]
    got = progress.fold_status(spark.createDataFrame(rows, "k int, i int, stage string, status string").repartition(3), "k", ["i"]).collect()
    assert {r.k: r.status for r in got} == {k: loop(e) for k, e in keys.items()}


def test_parser_does_not_depend_on_the_cuts():
    text = 'a [[b]] [[CHART_SLOT:{"id": 1}]] c [[CHART_ [[CHART_SLOT:x]][[CHART_SLOT:y]] end [[CHART_SLOT:open'
    rng = random.Random(2)

    def parse(pieces):
        p = progress.MarkerParser()
        out = [x for piece in pieces for x in p.feed(piece)] + p.finish()
        return "".join(f"<{t}>" if k == "marker" else t for k, t in out)

    want = parse([text])
    assert want == 'a [[b]] <{"id": 1}> c [[CHART_ <x><y> end [[CHART_SLOT:open'
    for _ in range(200):
        cuts = sorted(rng.sample(range(len(text)), rng.randint(0, 12)))
        assert parse([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]) == want


def test_marker_stream(spark, tmp_path):
    texts = {1: "x [[CHART_SLOT:a]] y", 2: "no marker [[", 3: "[[CHART_SLOT:b]]"}
    rows = [{"m": k, "i": i, "t": t[a : a + 3], "last": a + 3 >= len(t)} for k, t in texts.items() for i, a in enumerate(range(0, len(t), 3))]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in range(0, 8):
        part = [r for r in rows if r["i"] == n]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    stream = spark.readStream.schema("m int, i int, t string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = progress.marker_stream(stream, "m", "i", "t", "last").writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema("m int, kind string, part string").json(str(out)).toPandas()
    assert isinstance(got, pd.DataFrame)
    for k in texts:
        markers = got[(got.m == k) & (got.kind == "marker")].part.tolist()
        assert markers == ({1: ["a"], 2: [], 3: ["b"]}[k])
        assert got[(got.m == k)].part.str.len().sum() == len(texts[k]) - (len("[[CHART_SLOT:]]") if markers else 0)


def run_stream(spark, tmp_path, batches, **options):
    """Parts of each message, in the order of their micro-batches."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("m int, i int, t string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = progress.marker_stream(stream, "m", "i", "t", "last", **options).writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).coalesce(1).write.mode("append").json(str(out)))
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema("m int, kind string, part string, n long").json(str(out)).collect()
    return {m: sorted((r.n, r.kind, r.part) for r in got if r.m == m) for m in {r.m for r in got}}


def test_marker_stream_takes_pieces_in_any_order(spark, tmp_path):
    text = "before [[CHART_SLOT:a]] between [[CHART_SLOT:b]] after"
    cut = [text[a : a + 4] for a in range(0, len(text), 4)]
    rows = [{"m": m, "i": i, "t": t, "last": i == len(cut) - 1} for m in range(6) for i, t in enumerate(cut)]
    random.Random(4).shuffle(rows)
    batches = [rows[n::7] for n in range(7)]
    batches.append([r for r in rows if r["i"] in (2, len(cut) - 1)])  # pieces that come again
    got = run_stream(spark, tmp_path, batches)
    want = progress.MarkerParser()
    parts = [x for t in cut for x in want.feed(t)] + want.finish()
    for m in range(6):
        assert [p for _, k, p in got[m] if k == "marker"] == ["a", "b"]
        assert sum(len(p) for _, k, p in got[m] if k == "text") == sum(len(p) for k, p in parts if k == "text")


def test_marker_stream_holds_what_is_ahead(spark, tmp_path):
    """Nothing after a missing piece is settled before it comes."""
    rows = [{"m": 1, "i": i, "t": t, "last": i == 3} for i, t in enumerate(["ab", "[[CHART_", "SLOT:x", "]]cd"])]
    got = run_stream(spark, tmp_path, [[rows[3], rows[0]], [rows[2]], [rows[1]]])
    assert {(k, p) for _, k, p in got[1]} == {("text", "ab"), ("marker", "x"), ("text", "cd")}
    assert len({n for n, k, p in got[1] if p in ("x", "cd")}) == 1


class State:
    """Stands for a group's state."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.duration = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.duration = ms


def test_marker_stream_gives_up_what_does_not_come():
    state = State()
    frame = pd.DataFrame({"i": [0, 2], "t": ["x [[CHART_SLOT:a", " y"], "last": [False, True]})
    first = pd.concat(progress.marker_step((1,), iter([frame]), state, ("m", "i", "t", "last"), 0, 5000))
    assert first.part.tolist() == ["x "] and state.duration == 5000
    state = State(state.value, timed_out=True)
    rest = pd.concat(progress.marker_step((1,), iter([]), state, ("m", "i", "t", "last"), 0, 5000))
    assert "".join(rest.part) == "[[CHART_SLOT:a y" and not state.exists


def test_leading_block_does_not_depend_on_the_cuts(spark):
    o, c = progress.SHELL_OPEN, progress.SHELL_CLOSE
    texts = [f'  {o} {{"a": 1}} {c}body {o} more', f"{o}never closed", "plain text", f"{o[:5]}not it", "  ", f"{o}x{c}"]
    rng = random.Random(6)

    def parse(pieces):
        p = progress.LeadingBlockParser()
        out = [x for piece in pieces for x in p.feed(piece)] + p.finish()
        return [t for k, t in out if k == "shell"], "".join(t for k, t in out if k == "text")

    want = [parse([t]) for t in texts]
    assert want[0] == (['{"a": 1}'], f"body {o} more") and want[1] == ([""], texts[1]) and want[5] == (["x"], "")
    for text, w in zip(texts, want):
        for _ in range(50):
            cuts = sorted(rng.sample(range(len(text)), rng.randint(0, min(6, len(text) - 1))))
            assert parse([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]) == w
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", progress.leading_block(F.col("t")).alias("b")).orderBy("i").select("b.*").collect()
    assert [(r.shell or "", r.body) for r in got] == [((s or [""])[0], b) for s, b in want]


def test_digest_discards_and_adds(spark):
    rows = [
        ("k", "a", 1, "research_started", "running", "first   note"), ("k", "a", 2, "combo_complete", "success", None), ("k", "b", 3, "combo_incomplete", "error", None),
        ("k", "b", 4, "research_strategy", "running", "second"), ("k", "c", 5, "no_available_data", "running", None), ("k", None, 6, "research_strategy", "started", "third"),
        (None, "z", 7, "research_strategy", "other", " "), ("k", "a", 8, "unheard", None, None), ("k", "d", 9, None, "started", None),
    ]
    events = spark.createDataFrame(rows, "key string, label string, n int, stage string, status string, message string")
    states = progress.label_states(events, "key", "label", ["n"])
    told = {r.key: r for r in progress.digest(states, "key", "label").collect()}
    assert told["k"].digest == "Unavailable data: c. Research in progress for b, d. Completed research for a. Incomplete findings for b."
    assert (told["k"].n_active, told[None].digest) == (2, None)
    notes = {r.key: r.notes for r in progress.last_notes(events, "key", ["n"], "research_strategy", "message").collect()}
    assert notes == {"k": "second third"}
    assert progress.last_notes(events, "key", ["n"], "research_started", "message").first().notes == "first note"
    assert progress.digest(progress.label_states(events.limit(0), "key", "label", ["n"]), "key", "label").count() == 0
