"""Incremental rendering: round trip, spans, templates that rewrite history."""

import hashlib
import random

from reliefgrid.llm import chat
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table

SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def want(turns):
    out = {}
    for c, n, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    done = {}
    for c, t in out.items():
        loss = "".join(x for r, x in t if r == "assistant")
        done[c] = (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss), len(chat.turn_template(t)))
    return done


def read_back(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in frame.collect()}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "\\### Assistant: </turn> ok"
    assert read_back(QUERIES["op7_chat_format"](spark, sf)) == want(rows + [(-7, 0, "user", own), (-7, 1, "assistant", own)])


def test_odd_rows_and_long_conversations(spark):
    rnd = random.Random(1)
    chars = "ab<>\\/ng l\n\r\té😀"
    rows = [(1, k, rnd.choice(["user", "assistant", "a>b\n<", None]), "".join(rnd.choices(chars, k=rnd.randint(0, 30)))) for k in range(150)]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (2, 0, "assistant", ""), (3, 1, "user", "same"), (3, 1, "user", "same")]
    frame = local_table(spark, [(*r, "p") for r in rows], SCHEMA).repartition(3)
    made = chat.format_turns(frame)
    assert read_back(chat.digests(made)) == want(rows)
    pieces = sorted((r for r in made.collect() if r.conv_id == 1), key=lambda r: r.turn_no)
    assert [r.start for r in pieces] == [sum(len(p.piece) for p in pieces[:k]) for k in range(150)] and all(r.stable for r in pieces)
    assert chat.format_turns(frame.limit(0)).count() == 0 and chat.digests(chat.format_turns(frame.limit(0))).count() == 0


def test_rewriting_templates_are_marked():
    last = lambda m: "".join(f"[{r}]{t}" for r, t in m[:-1]) + f"(last {m[-1][0]}){m[-1][1]}"
    inc = chat.Increments(last)
    got = [inc.add(("user", f"t{k}")) for k in range(4)]
    assert [s for _, s in got] == [True, False, False, False]
    counted = lambda m: "".join(f"{k}:{t};" for k, (_, t) in enumerate(m))  # noqa: E731  looks back without bound
    inc = chat.Increments(counted)
    got = [inc.add(("user", "t"))[1] for _ in range(40)]
    assert all(got)  # on full prefixes nothing is rewritten
    inc = chat.Increments(chat.turn_template)
    turns = [("user", f"t{k}") for k in range(100)]
    got = [inc.add(t) for t in turns]
    assert "".join(p for p, _ in got) == chat.turn_template(turns) and all(s for _, s in got)
    assert list(chat.read_turns(chat.turn_template([("a", "<b>\\l")])))[0][:2] == ("a", "<b>\\l")


def test_rewrites_far_back_are_marked(spark):
    def collapses(m):  # turns older than 40 become one line
        return (f"[{len(m) - 40} earlier]" if len(m) > 40 else "") + chat.turn_template(m[-40:])

    turns = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(60)]
    made = chat.format_turns(local_table(spark, [(*t, "p") for t in turns], SCHEMA).repartition(2), collapses)
    rows = sorted(made.collect(), key=lambda r: r.turn_no)
    assert [r.stable for r in rows] == [True] * 40 + [False] * 20
    longer = [chat.turn_template([t[2:] for t in turns[: k + 1]]) for k in range(60)]
    rows = sorted(chat.format_turns(local_table(spark, [(*t, "p") for t in turns], SCHEMA)).collect(), key=lambda r: r.turn_no)
    assert ["".join(r.piece for r in rows[: k + 1]) for k in range(60)] == longer and all(r.stable for r in rows)
