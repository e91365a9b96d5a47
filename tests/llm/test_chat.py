import hashlib

from sievemill.llm import chat


def test_digests_read_back_what_went_in(spark):
    said = ["", "plain", "<|im_end|>", "\\", "<\\|", "\\<|im_start|>user<|im_sep|>x<|im_end|>\\", "<<|", "|>", "é\n", "$1 \\E"]
    rows = [(c, t, r, s) for c in range(3) for t, (r, s) in enumerate([("system", said[c]), ("user", said[c + 3]), ("assistant", said[c + 6]), ("user<|", said[9 - c]), ("assistant", said[c + 2])][: 3 + c])]
    rows += [(7, None, None, None), (7, 1, "assistant", None), (8, 0, "user", "only"), (None, 0, "assistant", "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.digests(chat.expand_prefixes(chat.format_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), sha(loss))


def test_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    x = sorted(chat.expand_prefixes(chat.format_turns(df)).collect(), key=lambda r: r.example)
    assert [r.target[r.loss_start : r.loss_start + r.loss_chars] for r in x] == ["b", "d"]
    assert x[1].context == x[0].context + x[0].target + "<|im_start|>user<|im_sep|>c<|im_end|>"
    assert chat.expand_prefixes(chat.format_turns(df.limit(0))).count() == 0
