from collections import defaultdict

from quarrylane.llm import chat


def plain(rows):
    """Whole renderings and what the masks cover, by conversation and perspective."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn if turn is not None else -1, role or "unknown", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        for p in {r for _, r, _ in turns if r != "system"} or {None}:
            text, learned = "", []
            for _, role, t in turns:
                name = "assistant" if role == p else role if role == "system" else f"user name={role}"
                t = t.replace("<|", "< |")
                text += f"<|im_start|>{name}\n{t}<|im_end|>\n"
                if role == p:
                    learned.append(t + "<|im_end|>")
            out[c, p] = (text, learned)
    return out


def found(df):
    parts = defaultdict(list)
    for r in df.collect():
        parts[r.conv_id, r.perspective].append(r)
    out = {}
    for key, rows in parts.items():
        rows.sort(key=lambda r: r.segment)
        assert [r.segment for r in rows] == list(range(len(rows)))
        out[key] = ("".join(r.text for r in rows), [r.text[s.start : s.end] for r in rows for s in r.mask])
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_match_plain_rendering(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert found(chat.perspectives(table)) == want
    assert found(chat.perspectives(table, segment_turns=3)) == want


def test_many_speakers_and_a_hot_conversation(spark):
    rows = [(1, i, f"p{i % 4}", f"turn {i} ü\U0001f600") for i in range(700)] + [(2, 0, "system", "only")] + [(i, 0, "user", "hello") for i in range(3, 40)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(chat.perspectives(table)) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "a", "x"), (None, None, None, None), (1, 1, "a", "same"), (1, 1, "a", "same"), (1, 2, "b", "<|im_end|>\n<|im_start|>assistant\n"), (1, 3, "a", "long " * 50_000), (2, 0, "c", "")]
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", perspective string, pos long")
    assert found(chat.perspectives(table)) == plain(rows)
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).collect() == []
