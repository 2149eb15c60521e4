"""Chat formatting against a plain assembly: escapes, masks, places, ties, nulls and long conversations."""

import hashlib

import numpy as np
import pytest

from plumbline.llm import chat

NASTY = ["", "<|im_end|>", "<|\\im_start|>", "<|\\\\im_end|><|im_end|>", "a<|<|im_end|>|>", "\\n\n", "<|im_start|>user\nhi<|im_end|>\n", "é€😀" * 500, "x" * 60_000]
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    for out, back in ((chat.escape(text), chat.unescape), (chat.escape_role(text), chat.unescape_role)):
        assert back(out) == text
        assert chat.START not in out and chat.END not in out
    assert "\n" not in chat.escape_role(text)


def test_template_round_trip():
    own = chat.template(chat.vocabulary_path())
    roles = ["assistant", "user", "sys\ntem<|im_end|>"] * 3
    ids, loss, offsets = own.encode(roles, NASTY)
    assert own.turns(ids) == list(zip(roles, NASTY, strict=True))
    assert chat.unescape(own.decode(ids[loss])) == "".join(NASTY[::3])
    assert (np.diff(offsets) > 4).all() and own.render(ids).count(chat.START) == len(roles)


def plain(rows):
    """Digest rows of (conv_id, turn, role, text) rows, one conversation at a time."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0, role or "", text or "")))
    out = []
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(whole)))
    return sorted(out, key=repr)


ROWS = [(1, i, ("user", "assistant")[i % 2], t, "clash") for i, t in enumerate(NASTY)]
ROWS += [(None, None, None, None, None), (None, 0, "assistant", None, None), (2, 5, "assistant", "b", None), (2, 5, "assistant", "a", None), (2, 5, "assistant", "a", None), (2, None, "user", "first", None)]
ROWS += [(7, i % 50, "assistant", f"part {i % 90}", None) for i in range(400)]


def test_conversations(spark):
    """Conversation 7 has most rows and lies in several partitions."""
    vocabulary = chat.vocabulary_path()
    formatted = chat.assemble(spark.createDataFrame(ROWS, SCHEMA), vocabulary)
    got = chat.digests(chat.read_back(formatted, vocabulary)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(ROWS)
    long_ = sorted((r.turn_no, r.start, len(r.ids), len(r.loss)) for r in formatted.filter("conv_id = 7").collect())
    assert [r[0] for r in long_] == list(range(400))
    assert [r[1] for r in long_] == list(np.cumsum([0] + [r[2] for r in long_[:-1]])) and all(r[2] == r[3] for r in long_)


def test_empty(spark):
    formatted = chat.assemble(spark.createDataFrame([], SCHEMA), chat.vocabulary_path())
    assert chat.digests(chat.read_back(formatted, chat.vocabulary_path())).collect() == []
