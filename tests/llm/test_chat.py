from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat
from quillon.llm.chat import INSTRUCT, Template, Turn, chat_digests, format_chats

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, formatted int, state string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    texts = [None, "", " ", "\\", "</s>[INST] ok [/INST]", "<s", "[INST", "[\\INST]", "<</END>>\\", "\n<</SYS>>\n", "é日𝄞 [/INST]", "x" * 200_000]
    roles = ["system", "user", "assistant", "tool", "<</ROLE>>", None, ""]
    out = [(c, t, r, f"text {c} {t}") for c in range(20) for t, r in enumerate(["user", "assistant"] * rng.randint(1, 3))]
    out += [(100, rng.choice([*range(-1500, 4000), None]), rng.choice(roles), rng.choice(texts)) for _ in range(1500)]  # many chunks, ties
    out += [(None, t, "user", "no conversation") for t in (2, 1, None)] + [(101, None, "assistant", "x"), (101, 0, "user", "y")]
    return [(*r, "own", 1, "own") for r in out + out[:30]]  # repeated rows


def brute(rows):
    of = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        of[conv].append((turn is None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, turns in of.items():
        state, n_bad, n_chars = "start", 0, 0
        told, loss = "", ""
        for *_, role, text in sorted(turns):
            role, text = role.decode(), text.decode()
            parts, state, ordered = INSTRUCT.segments(state, role, text)
            n_bad += not ordered
            n_chars += sum(len(p) for p, _ in parts)
            told += f"{role}\n{text}\n"
            loss += text if role == "assistant" else ""
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(told), len(loss), digest(loss), n_chars, n_bad)
    return out


def test_digests_equal_brute_force(spark, turns):
    pieces = format_chats(spark.createDataFrame(turns, SCHEMA).repartition(5))
    got = chat_digests(pieces)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute(turns)
    kept = pieces.filter("conv_id = 100").select("whole", "chunk", "piece").collect()
    assert len({r.chunk for r in kept}) > 5 and not any(r.whole for r in kept)
    assert pieces.filter("conv_id < 20 AND NOT whole").count() == 0


def test_pieces_end_between_turns_and_mark_the_loss(spark, turns, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 300)
    pieces = format_chats(spark.createDataFrame(turns, SCHEMA)).collect()
    for p in pieces:
        read = list(INSTRUCT.read_turns(p.formatted))
        assert len(read) == p.n_turns
        assert "".join(t for r, t in read if r == "assistant") == "".join(INSTRUCT.unescape(p.formatted[s.start : s.stop]) for s in p.loss)
    assert sum(p.n_turns for p in pieces) == len(turns)


def test_the_machine_follows_long_conversations_over_chunks(spark, monkeypatch):
    """A role that leaves the state as it is can stand between any two chunks."""
    monkeypatch.setattr(chat, "CHUNK_BITS", 1)
    roles = ["system", "user", "tool", "tool", "assistant", "tool", "tool", "tool", "user", "user", "assistant", "system"]
    rows = [(1, i, r, "t", "", 0, "") for i, r in enumerate(roles)]
    pieces = format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk").collect()
    bad, at = [], 0
    for p in pieces:
        bad += [at + b for b in p.out_of_order]
        at += p.n_turns
    assert bad == [2, 3, 5, 6, 7, 9, 11]
    assert "".join(p.formatted for p in pieces).count("<s>") == 3  # before the first, after each answer


_texts = st.text(st.sampled_from([*"<s>/[]INSTYROLED \\\n", "é", "𝄞"]), max_size=60) | st.sampled_from(INSTRUCT.control)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]) | _texts, _texts), max_size=6))
def test_any_texts_are_read_back(turns):
    state, out = "start", ""
    for role, text in turns:
        escaped = INSTRUCT.escape(text)
        assert not any(c in escaped for c in INSTRUCT.control)
        parts, state, _ = INSTRUCT.segments(state, role, text)
        out += "".join(p for p, _ in parts)
    assert list(INSTRUCT.read_turns(out)) == turns


def test_templates_that_cannot_be_read_back_are_refused():
    def made(**more):
        base = {"turns": {"user": Turn("<u>", "</u>")}, "moves": {}, "after": {}, "control": ("</u>", "<u>", "</o>", "</n>"), "other": Turn("<o>", "</o>"), "names_end": "</n>"}
        return Template(**base | more)

    assert list(made().read_turns("<u>a</u>")) == [("user", "a")]
    for wrong in (
        {"control": ("</u>", "</o>")}, {"turns": {"user": Turn("<u>", "</u></u>x</u></u>"), "bot": Turn("<u>x", "</o>")}},
        {"control": ("</u>", "</o>", "</n>", "n></")}, {"control": ("a\\b", "</u>", "</o>", "</n>")}, {"turns": {"user": Turn("<o>", "</u>")}},
    ):
        with pytest.raises(ValueError):
            made(**wrong)
    with pytest.raises(ValueError):
        list(INSTRUCT.read_turns("[INST] never closed"))


def test_nothing_gives_nothing(spark):
    assert chat_digests(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
