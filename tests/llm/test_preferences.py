from ledgerline.llm.preferences import preference_pairs, shortened_answers

TURNS = "conv_id long, turn long, role string, text string"


def brute(chosen, rejected):
    out = {}
    sides = [{}, {}]
    for side, rows in zip(sides, (chosen, rejected)):
        for c, t, r, x in rows:
            if c is not None:
                side.setdefault(c, set()).add((-(2**63) if t is None else t, r or "", x or ""))
    for c in sides[0].keys() | sides[1].keys():
        a, b = (sorted(s.get(c, ())) for s in sides)
        odd = set(a) ^ set(b)
        cut = min((t for t, *_ in odd), default=2**63)
        show = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in ts)
        prompt = [t for t in a if t[0] < cut]
        out[c] = (len(prompt), show(prompt), show([t for t in a if t[0] >= cut]), show([t for t in b if t[0] >= cut]))
    return out


def test_against_brute_force(spark, docs):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, "user", "and?"), (2, 0, "user", "only chosen"), (3, 0, "user", "same"), (4, 0, None, None), (4, None, "user", "first"), (None, 0, "user", "x"), (5, 0, "a", "b"), (5, 0, "a", "c"), (7, 0, "user", "x " * 50000)]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (3, 0, "user", "same"), (4, 0, "", ""), (4, None, "user", "other"), (5, 0, "a", "b"), (6, 3, "user", "only rejected")]
    out = preference_pairs(docs([(*r, 1) for r in chosen], TURNS + ", prompt int"), docs(rejected, TURNS))
    got = {r["conv_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) for r in out.collect()}
    assert got == brute(chosen, rejected)


def test_masks_cover_completions_and_learn_answers_only(spark, docs):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes é"), (1, 2, "user", "and?"), (1, 3, "assistant", "more")]
    row = preference_pairs(docs(chosen, TURNS), docs(chosen[:1], TURNS)).first()
    at, learned = 0, ""
    for part in row["chosen_mask"]:
        if part["learn"]:
            learned += row["chosen"][at : at + part["chars"]]
        at += part["chars"]
    assert at == len(row["chosen"]) and learned == "yes é<|end|>\nmore<|end|>\n"
    assert row["rejected"] == "" and row["rejected_mask"] == []


def test_shortened_answers(spark, docs):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "bye"), (2, 0, "user", "alone")]
    got = sorted(tuple(r) for r in shortened_answers(docs(rows, TURNS)).select("conv_id", "turn", "role", "text").collect())
    assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "abc"), (2, 0, "user", "alone")]


def test_empty_tables(spark, docs):
    assert preference_pairs(docs([], TURNS), docs([], TURNS)).collect() == []
