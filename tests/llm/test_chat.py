import hashlib
import random

from quoteflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n int, tie int, seq int, kind string, body string, copy int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


def formatted(spark, rows, delta=512):
    return chat.render(chat.fold(chat.as_events(rows_of(spark, rows), delta)))


def test_round_trip(spark):
    rnd = random.Random(1)
    parts = ["<", "|", "\\", "<|", "<|im_end|>", "<|im_start|>assistant\n", "\n", "%0A", "é😀", "ok", "<\\|", "<\\\\|im_end|>\n", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a\nb%0A<|im_end|>"]), rnd.choice([None, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))])) for c in (-1, 3, 4, None) for t in range(20)]
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", "same"), (5, None, None, None), (6, 0, "assistant", "")]
    for delta in (3, 512):
        got = {r.conv_id: r for r in chat.read_back(formatted(spark, rows, delta)).collect()}
        for conv in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
            turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
            loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
            r = got[conv]
            assert r.n_turns == len(mine) and r.loss_chars == len(loss)
            assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    pieces = formatted(spark, rows).where("conv_id = 5").collect()
    assert got[5].formatted_chars == sum(len(p.piece) for p in pieces)
    assert all("<|" not in p.piece.removeprefix(chat.START).removesuffix(chat.END + "\n") for p in formatted(spark, rows).collect())
    assert chat.read_back(formatted(spark, [])).collect() == []


def test_the_log_has_every_kind_of_event_and_long_messages_survive(spark):
    rows = [(1, 0, "user", "abc" * 5000), (1, 1, "assistant", "<|im_end|>" * 3000), (1, 2, "user", "")]
    log = chat.as_events(rows_of(spark, rows))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    assert [(r.turn, r.role, r.text) for r in chat.fold(log).orderBy("turn").collect()] == [r[1:] for r in rows]
    assert chat.read_back(chat.render(chat.fold(log))).first().loss_chars == 30_000


def test_fold(spark):
    log = [
        (1, 0, 0, "open", "assistant", None), (1, 0, 1, "delta", None, "bad "), (1, 0, 2, "regenerate", None, None), (1, 0, 4, "delta", None, "old"),
        (1, 0, 3, "delta", None, "very "), (1, 0, 5, "edit", None, "new"), (1, 0, 6, "delta", None, " text"), (1, 0, 6, "delta", None, " text"), (1, 0, 7, "seen", None, "?"),
        (1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, None), (2, 0, 9, "delta", None, "no opening"), (3, 0, 0, "seen", None, "x"),
        (4, 0, 1, "edit", None, "b"), (4, 0, 1, "regenerate", None, None), (4, 0, 1, "delta", None, "c"), (4, 0, 1, "open", "user", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq int, kind string, role string, body string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events, ("turn",)).collect()}
    assert got == {(1, 0): ("assistant", "new text"), (1, 1): ("user", ""), (2, 0): (None, "no opening"), (4, 0): ("user", "bc")}


def test_reader_rejects_what_is_no_turn():
    import pytest

    with pytest.raises(ValueError):
        chat.Reader().feed("text")
