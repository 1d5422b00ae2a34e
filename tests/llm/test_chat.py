"""Role repair against an exhaustive search."""

import collections
import random
import re
from functools import cache

from skywake.llm import chat


def _cheapest(roles):
    """Least cost over all legal sequences, by search over (turn, last role written)."""
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    @cache
    def best(place, last, inserted):
        if inserted > 3:
            return 10**9
        if place == len(roles):
            costs = [0] if last in ("assistant", None) else []
        else:
            role = roles[place]
            relabel = lambda to: 0 if to == role else 1 if role not in chat.ROLES else 3
            costs = [relabel(to) + best(place + 1, to, 0) for to in follows[last]]
            if last:
                costs.append(relabel(last) + 1 + best(place + 1, last, 0))
        costs += [2 + best(place, to, inserted + 1) for to in follows[last]]
        return min(costs)

    return best(0, None, 0)


def _check(rows, held):
    turns, out = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn, role or "", text or ""))
    for r in sorted(held, key=lambda r: r.seq):
        out[r.conv_id].append(r)
    assert out.keys() == turns.keys()
    for conv, given in turns.items():
        given.sort(key=lambda t: (t[0], t[1] or 0))
        roles = [t[2].strip().lower() for t in given]
        assert sum(r.cost for r in out[conv]) == _cheapest(tuple(r if r in chat.ROLES else "" for r in roles))
        assert sorted(r.text for r in out[conv] if r.action != "insert") == sorted(t[3] for t in given)
        whole = "".join(r.rendered for r in out[conv])
        heads = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert whole.endswith(chat.TAIL) and whole.count(chat.TAIL) == len(heads)
        body = heads[1:] if heads[0] == "system" else heads
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert len(heads) == sum("merge" not in r.action for r in out[conv])


def test_repairs_are_legal_and_cheapest(llm):
    rng = random.Random(1)
    kinds = ["system", "user", "assistant", " User ", "tool", None, "ASSISTANT"]
    rows = [(conv, k, rng.choice(kinds), f"t{k}") for conv in range(120) for k in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", None), (500, None, "user", ""), (500, 1, "user", "b"), (501, 1, "user", "same"), (501, 1, "user", "same")]
    rows += [(600, k, rng.choice(kinds[:3]), f"u{k}") for k in range(200)]  # one conversation with many turns
    frame = llm.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    whole = chat.repair(frame).collect()
    _check(rows, whole)
    assert chat.repair(frame.limit(0)).count() == 0


def test_very_long_texts_stay_with_their_turns(llm):
    texts = [chr(97 + k) * 1_500_000 for k in range(6)]
    rows = [(1, k, ["user", "user", "assistant", "x", "system", "user"][k], texts[k]) for k in range(6)]
    frame = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = chat.repair(frame, run=2).collect()
    _check(rows, held)
    assert {r.turn: r.text for r in held if r.turn is not None} == dict(enumerate(texts))


def test_runs_give_what_whole_conversations_give(llm, monkeypatch):
    rng = random.Random(2)
    rows = [(conv, k, rng.choice(["system", "user", "assistant", "x"]), f"t{k}") for conv, n in ((1, 150), (2, 3), (3, 40), (None, 30)) for k in range(n)]
    frame = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = collections.Counter(map(tuple, chat.repair(frame).collect()))
    monkeypatch.setattr(chat, "FAN", 3)
    assert collections.Counter(map(tuple, chat.repair(frame, run=4).collect())) == whole


def test_costs_multiply():
    roles = ["user", "assistant", "", "system"] * 3
    assert (chat.run_matrix(roles) == chat.times(chat.run_matrix(roles[:5]), chat.run_matrix(roles[5:]))).all()
