import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from tallyhouse.llm import chat, registry, rollup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens bigint")


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.documents, x.tokens) for x in r.totals().collect()}


def test_batches_count_once_and_in_any_order(spark):
    r = rollup.TokenRollup(spark)
    assert totals(r) == {}
    first = frame(spark, [("a", "en", "v1", 5), ("a", "en", "v1", 7), ("b", None, "v1", None), ("a", "en", "v2", 4)])
    assert r.commit("b1", rollup.inserts(first)) and not r.commit("b1", rollup.inserts(first))
    assert totals(r) == {("a", "en", "v1"): (2, 12), ("b", None, "v1"): (1, 0), ("a", "en", "v2"): (1, 4)}
    r.commit("b2", rollup.deletes(frame(spark, [("a", "en", "v2", 4)])))
    r.commit("b3", rollup.revisions(frame(spark, [("a", "en", "v1", 7)]), frame(spark, [("a", "en", "v1", 70)])))
    want = {("a", "en", "v1"): (2, 75), ("b", None, "v1"): (1, 0)}
    assert totals(r) == want
    r.compact("folded")
    assert totals(r) == want and not r.commit("b2", rollup.inserts(first))
    # a batch that failed before its marker is written anew
    rollup.inserts(first).groupBy("source", "lang", "tokenizer").count().write.parquet(f"{r.path}/deltas/b4")
    assert r.commit("b4", rollup.deletes(frame(spark, [("b", None, "v1", 0)]))) and totals(r) == {("a", "en", "v1"): (2, 75)}


def test_rollup_query(spark, tmp_path):
    rows = [(1, "one two", "en", "s1"), (2, "one two", "en", "s2"), (3, None, None, "s1"), (4, "", "en", None), (5, "Ünïcode 12", "de", "s1"), (5, "Ünïcode 12", "de", "s1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in registry.op1_token_counts(spark, str(tmp_path)).collect()}
    want = {}
    seen = set()
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        seen.clear()
        for _, text, lang, source in rows:
            if (text or "") in seen:
                continue
            seen.add(text or "")
            d, t = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (d + 1, t + len(e.encode_ordinary(text or "")) + 1)
    assert got == want


def brute_viterbi(model, symbols):
    best = model.start + model.emit[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        o = best[:, None] + model.step
        back.append(o.argmax(axis=0))
        best = o.max(axis=0) + model.emit[:, s]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def some_turns(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(12):
        for t in range(r.choice([1, 2, 5, 9])):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2]
            text = "\n".join(" ".join(r.choice(["ab", "cd", "ef"]) for _ in range(r.choice([3, 5, 40] if role == "assistant" else [2, 4]))) + ("?" if role == "user" and r.random() < 0.6 else "") for _ in range(r.choice([1, 2, 4])))
            rows.append((c, t, role, text))
    rows += [(99, t, ("user", "assistant")[t % 2], f"line {t}\nmore") for t in range(150)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_blocks_give_the_path_of_the_whole(spark):
    rough = chat.rough_transcripts(some_turns(spark))
    model = chat.learn(rough)
    got = {}
    for x in chat.parse(rough, model, block=4).orderBy("conv", "place").collect():
        got.setdefault(x.conv, []).append((x.role, x.begins, x.line))
    right = total = 0
    for c, own in {c: [x for x in rough.collect() if x.conv == c] for c in got}.items():
        own.sort(key=lambda x: (x.turn, x.line_no))
        path = brute_viterbi(model, [chat.symbol(x.line) for x in own])
        n = len(chat.ROLES)
        best = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(model.emit[s, chat.symbol(x.line)] for s, x in zip(path, own, strict=True))
        states = [chat.ROLES.index(r) + (0 if b else n) for r, b, _ in got[c]]
        score = model.start[states[0]] + sum(model.step[a, b] for a, b in zip(states, states[1:], strict=False)) + sum(model.emit[s, chat.symbol(x.line)] for s, x in zip(states, own, strict=True))
        assert np.isclose(score, best) and len(states) == len(path)
        right += sum(r == x.role for (r, _, _), x in zip(got[c], own, strict=True))
        total += len(own)
    assert right / total > 0.85


def test_rendered_turns(spark):
    rows = [(1, 0, "user", "Hello there?"), (1, 1, "assistant", "Long answer " * 20 + "\nsecond line"), (1, 2, "user", "Thanks?")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    model = chat.learn(chat.rough_transcripts(some_turns(spark)))
    rough = chat.lines(spark.createDataFrame([(1, t, {"user": "Human: ", "assistant": "AI: "}[r] + x) for _, t, r, x in rows], "conv_id bigint, turn bigint, text string"))
    want = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, _, r, x in rows)
    for block in (2, 100):
        parts = chat.render(chat.parse(rough, model, block), block).orderBy("place").collect()
        assert "".join(p.text for p in parts) == want
    assert turns.count() == 3


def test_awkward_transcripts(spark):
    model = chat.learn(chat.rough_transcripts(some_turns(spark)))
    rows = [(None, None, None), (None, 1, "x"), (1, 1, ""), (1, 1, ""), (2, None, "User: hi\n\nno"), (2, 5, "a" * 100_000)]
    rough = chat.lines(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"))
    out = chat.parse(rough, model)
    assert out.count() == rough.count() == 8
    assert sorted((r.conv or 0, r.place) for r in out.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert chat.render(out).count() >= 3
    assert chat.parse(rough.limit(0), model).count() == 0
