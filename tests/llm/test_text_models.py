"""Language identification, toxicity and language-model scoring."""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.cases import CLASHING, frame, odd_rows
from veilmark.llm import attention, langid, lm, toxicity
from veilmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def remainder(doc_id, m):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % m


# ------------------------------------------------------------------ language id
def test_windows_cover_all_bytes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 251 * 3 + 5, 5000):
        raw = rng.integers(1, 255, n).astype(np.uint8)
        win, text, used = langid.windows_of(raw, np.array([0, n]))
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        assert (b"".join(w[:u][(0 if i == 0 else langid.WINDOW - step):].tobytes() for i, (w, u) in enumerate(zip(win, used, strict=True)))) == raw.tobytes()


def test_pair_tables_equal_the_convolution():
    net = langid.ByteNet.fresh(["a", "b"])
    x = np.random.default_rng(3).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    act = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        resp = sum(net.embedding[x[:, j:langid.WINDOW - w + 1 + j].astype(int)] @ f[j] for j in range(w))
        act.append(resp.max(axis=1))
    want = langid.softmax(np.maximum(np.concatenate(act, axis=1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.pair_tables()), want, atol=1e-5)


def test_language_id_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95


def test_weights_are_averaged_alike_in_any_order():
    rng = np.random.default_rng(5)
    sets = [(int(n), rng.normal(0, 1, 5000).astype(np.float32)) for n in rng.integers(1, 10**6, 7)]

    def average(order):
        rows = []
        for i in order:
            n, w = sets[i]
            high, low = np.divmod(lm.fixed(w), 1 << 16)
            rows.append({"piece": 0, "n": n, "weights": (np.stack([high, low]) * n).tobytes()})
        import pyarrow as pa

        (out,) = lm._added(iter([pa.RecordBatch.from_pylist(rows)]))
        (row,) = out.to_pylist()
        return lm.averaged(row["n"], row["weights"])

    one = average(range(7))
    assert all((average(rng.permutation(7)) == one).all() for _ in range(5))
    want = sum(n * w.astype(np.float64) for n, w in sets) / sum(n for n, _ in sets)
    assert np.abs(one - want).max() < 1e-6


def naive_score(model, ids):
    """The log probability of one text, id by id, in plain loops over the weights."""
    p, v, a = {k: np.asarray(x, np.float64) for k, x in model.p.items()}, model.vocabulary, attention
    inputs, follow = [a.END, *ids], [*ids, a.END]
    e = [p["emb"][v.symbol[i]] for i in inputs]
    total = 0.0
    for t, y in enumerate(follow):
        window = t // a.SCORED * a.SCORED - a.CONTEXT  # first input that this window holds
        heads = []
        for h in range(a.HEADS):
            at = range(max(0, window), t + 1)
            s = np.array([(e[t] @ p["q"][h]) @ (e[j] @ p["k"][h]) + p["rel"][h][t - j] for j in at])
            s = np.exp(s - s.max())
            heads.append(sum(w * (e[j] @ p["v"][h]) for w, j in zip(s / s.sum(), at, strict=True)))
        before = e[t - 1] if t else np.zeros(a.EMBEDDING)
        z = np.tanh(e[t] @ p["a"] + before @ p["a1"] + np.concatenate(heads) @ p["b"] + p["c"])

        def log_softmax(logits, k):
            return logits[k] - logits.max() - np.log(np.exp(logits - logits.max()).sum())

        c = v.klass[y]
        total += log_softmax(z @ p["oc"] + p["bc"], c)
        if c < a.HEAD_CLASSES:
            total += log_softmax(z @ p["ow"][c] + p["bw"][c], v.member[y])
        else:
            tc, m = divmod(int(v.tail[y]), a.TAIL_SIZE)
            total += log_softmax(z @ p["tc"] + p["tb"] + v.tail_class, tc)
            total += log_softmax((z @ p["tp"]) @ p["tw"][tc] + p["tm"][tc] + v.tail_member[tc], m)
    return total


def test_model_scores_equal_plain_loops():
    rng = np.random.default_rng(6)
    counts = np.zeros(attention.VOCABULARY)
    counts[:3000] = rng.integers(1, 1000, 3000)
    counts[attention.END] = 50
    model = attention.Model(attention.Vocabulary.of(counts), seed=3)
    for k, w in model.p.items():
        model.p[k] = (w + rng.normal(0, 0.2, w.shape)).astype(np.float32)
    model.p["emb"][-1] = 0
    texts = [rng.integers(0, 3500, n) for n in (0, 1, 31, 32, 33, 70, 150)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = model.score(np.concatenate(texts).astype(np.int64), off)
    assert np.allclose(got, [naive_score(model, t.tolist()) for t in texts], rtol=1e-4)


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_language_id_cases(spark, extra):
    rows = odd_rows()
    got = langid.identify(frame(spark, rows, extra)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    texts = {r[0]: r[1] for r in rows}
    for i, r in by_id.items():
        if i is not None:
            letter = any(unicodedata.category(c).startswith("L") for c in texts[i] or "")
            assert (r["lang_pred"] == "und") == (not letter)
    odd = ["½²①", "12 _ ٣", "Ⅷ", "ª", "語", "ǅ", "1a"]
    seen = langid.identify(frame(spark, rows + [(10_000 + i, t, None, None, 1) for i, t in enumerate(odd)]))
    assert {odd[r["doc_id"] - 10_000]: r["lang_pred"] != "und" for r in seen.where("doc_id >= 10000").collect()} == {
        t: any(unicodedata.category(c).startswith("L") for c in t) for t in odd}
    unlabelled = [(1, "some text", None, "a", 1)]
    assert [tuple(r) for r in langid.identify(frame(spark, unlabelled)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert langid.identify(frame(spark, []).limit(0)).count() == 0


# --------------------------------------------------------------------- toxicity
def marks(text):
    g = toxicity.Grammar(["idiot$"], {})
    entries, m = g.matches(text)
    return dict(entries), {k: v for k, v in m.items() if v}


def test_grammar_clauses():
    assert marks("an idiot here") == ({"idiot$": 1}, {})
    assert marks("You are an IDIOT") == ({"idiot$": 1}, {"directed": 1})
    assert marks("idiot, you") == ({"idiot$": 1}, {"directed": 1})
    assert marks("that is not an idiot") == ({"idiot$": 1}, {"negated": 1})
    assert marks("anna said the word idiot. idiot") == ({"idiot$": 2}, {"reported": 1})
    assert marks("idiotic idiots") == ({}, {})
    assert marks("kill the process") == ({}, {})
    assert marks("i will kill you") == ({}, {"threat": 1})
    assert marks("") == ({}, {})


def test_every_clause_counts_with_its_own_marks():
    insults = ["idiot", "moron", "loser", "scum", "jerk"]
    w = {f"{i}$": toxicity.PRIOR["insult"] for i in insults} | {k: v for k, v in toxicity.PRIOR.items() if k not in ("insult", "stem")}
    g = toxicity.Grammar(sorted(f"{i}$" for i in insults), w)
    one = g.logit("Anna said Bob is not an idiot.") - w["constant"]
    text = " ".join(f"Anna said Bob is not an {i}." for i in insults)
    assert abs(g.logit(text) - (w["constant"] + 5 * one)) < 1e-9
    assert abs(g.logit("You are an idiot. " * 40) - (w["constant"] + 40 * (w["idiot$"] + w["directed"]))) < 1e-9


def test_stem_and_whole_word_of_one_spelling():
    for entries in (["idiot", "idiot$"], ["idiot$", "idiot"]):
        g = toxicity.Grammar(entries, {})
        assert dict(g.matches("idiots and an idiot, idiotic")[0]) == {"idiot": 2, "idiot$": 1}


def test_composed_machine_equals_its_parts():
    rng = random.Random(4)
    machine = toxicity.Composed()
    for _ in range(300):
        tags = [rng.choice("OOOIYNRT") for _ in range(rng.randint(0, 12))]
        state, want = [0, 0, 0], []
        for t in tags:
            for i, part in enumerate(toxicity.PARTS):
                state[i], t = part(state[i], t)
            want.append(t)
        assert machine.run(tags) == want


def test_stems_branch_where_words_do():
    toxic = [f"lorem grumpf{x} ipsum" for x in ("a", "en", "ung", "lich")] * 1
    clean = [f"lorem ipsum dolor {i}" for i in range(200)]
    assert toxicity.learned_stems(toxic, clean) == ["grumpf"]


def naive_logit(text, entries, w):
    """The score's logit clause by clause and word by word, from the rules as they are described."""
    total = w["constant"]
    spelled = set(entries) | {t + "$" for t in toxicity.THREATS if t not in {e.rstrip("$") for e in entries}}
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)
        found = []
        for word in words:
            whole = word.split("'")[0]
            fits = [e for e in spelled if (whole == e[:-1] if e.endswith("$") else word.startswith(e))]
            found.append(max(fits, key=len, default=None))
        plain = [x if e is None else "" for x, e in zip(words, found, strict=True)]
        spent = set()  # negators that have found their insult
        for i, entry in enumerate(found):
            if entry is None:
                continue
            directed = any(x in toxicity.TARGETS for x in plain[max(0, i - 3):i] + plain[i + 1:i + 4])
            threat = entry.rstrip("$") in toxicity.THREATS
            near = [j for j in range(max(0, i - 3), i) if plain[j] in toxicity.NEGATORS]
            negated = bool(near) and not any(near[-1] < k < i for k in spent)
            if negated:
                spent.add(i)
            if threat and not directed:
                continue
            total += w["threat"] if threat else w[entry] + w["directed"] * directed
            total += w["negated"] * negated + w["reported"] * any(x in toxicity.REPORTERS for x in plain[:i])
    return total


def test_clause_scores_equal_a_plain_reading():
    rng = random.Random(12)
    entries = ["idiot", "idiot$", "moron$", "scumb", "kill$", "grum"]
    vocabulary = ["idiot", "idiots", "moron", "morons", "scumbag", "scum", "grumpf", "Kill", "hurt", "murderer", "you", "They", "not", "never", "isn't",
                  "said", "calls", "idiot's", "a", "b", "_", "words", "é", "idiot-like"]
    seen = set()
    for _ in range(3000):
        w = {k: rng.uniform(-3, 3) for k in [*entries, *toxicity.MARKS, "constant"]}
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", ", ", ". ", "! ", "\n"]) for _ in range(rng.randint(0, 14)))
        g = toxicity.Grammar(entries, w)
        assert abs(g.logit(text) - naive_logit(text, entries, w)) < 1e-9, text
        seen |= set(g.matches(text)[1]) | set(g.matches(text)[0])
    assert set(toxicity.MARKS) <= seen


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    held = [x for x in labels if got[x["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    hit = [x for x in held if got[x["doc_id"]]["predicted"]]
    assert sum(x["toxic"] for x in hit) >= 0.9 * len(hit)
    assert sum(x["toxic"] for x in hit) >= 0.85 * sum(x["toxic"] for x in held)


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_toxicity_cases(spark, extra):
    rows = [*odd_rows(), (999, "you idiot, you moron", "en", "a", 20)]
    df = frame(spark, rows, extra)
    labels = spark.createDataFrame([(r[0], 1, t) for r, t in zip(rows, [0, 1, None] * 30, strict=False)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(df, labels).collect()
    assert len(got) == len(rows)
    clean = toxicity.clean_documents(df, labels.limit(0))
    assert clean.columns == df.columns and clean.count() == len(rows) - 1  # the listed insults alone reject the last row
    assert toxicity.judge(df.limit(0), labels).count() == 0


# --------------------------------------------------------------- language model
def tiny_model():
    counts = np.zeros(attention.VOCABULARY)
    counts[:3000] = np.arange(3000, 0, -1)
    counts[attention.END] = 50
    return attention.Model(attention.Vocabulary.of(counts))


def test_attention_probabilities_sum_to_one():
    m = tiny_model()
    ids = np.arange(40, 49)
    x, first, _, _, _ = next(attention.windows(ids, np.array([0, len(ids)])))
    for position in (0, 5):
        y = np.zeros((attention.VOCABULARY, attention.SCORED), np.int64)
        y[:, position] = np.arange(attention.VOCABULARY)
        total = 0.0
        for a in range(0, attention.VOCABULARY, 4096):
            part = y[a:a + 4096]
            lp = m.log_probabilities(np.repeat(x, len(part), 0), np.repeat(first, len(part), 0), part)
            total += np.exp(lp[:, position]).sum()
        assert abs(total - 1) < 1e-3


def test_windows_score_each_id_once():
    off = np.array([0, 0, 1, 31, 95, 300])
    ids = np.arange(300) + 7
    seen = Counter()
    for x, first, y, wanted, text in attention.windows(ids, off, together=3):
        for i in range(len(text)):
            t = int(text[i])
            mine = ids[off[t]:off[t + 1]].tolist()
            full = [attention.END, *mine, attention.END]
            for j in np.flatnonzero(wanted[i]):
                seen[t, int(y[i, j])] += 1
                k = mine.index(y[i, j]) + 1 if y[i, j] != attention.END else len(full) - 1
                have = min(k, attention.CONTEXT + j + 1)
                assert x[i, attention.CONTEXT + j + 1 - have:attention.CONTEXT + j + 1].tolist() == full[k - have:k]
                assert first[i] == (k <= attention.SCORED)
    want = Counter((t, int(v)) for t in range(5) for v in ids[off[t]:off[t + 1]]) + Counter({(t, attention.END): 1 for t in range(5)})
    assert seen == want


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (np.zeros(0, int), np.array([0, 127, 128, 16383, 16384, 2097151, 2097152, 2**28 - 1]), rng.integers(0, 1 << 22, 5000)):
        assert (lm.unpacked(lm.packed(n)) == n).all()


def test_gradients_agree_with_differences():
    m = tiny_model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 2000, 150)
    x, first, y, wanted, _ = next(attention.windows(ids, np.array([0, 70, 150])))

    def loss():
        m.tables = None
        lp = m.log_probabilities(x, first, y)
        rare = m.vocabulary.klass[y] == attention.HEAD_CLASSES
        lp = lp - np.where(rare, m.vocabulary.rare[y], 0)
        return -lp[wanted].sum() / wanted.sum()

    grads = m._gradients(x, first, y, wanted)
    for name, g in grads.items():
        flat = m.p[name].reshape(-1)
        at = int(np.abs(g).reshape(-1).argmax())
        was, step = flat[at], 1e-4
        flat[at] = was + step
        up = loss()
        flat[at] = was - step
        down = loss()
        flat[at] = was
        assert math.isclose((up - down) / (2 * step), g.reshape(-1)[at], rel_tol=0.05, abs_tol=1e-6), name


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_lm_base_scores(spark, extra, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    rows = odd_rows()
    got = lm.score_documents(frame(spark, rows, extra), block_bytes=4000).collect()

    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]

    counts = Counter(w for r in rows if remainder(r[0], 10) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(r[0]), remainder(r[0], 10) == 0, len(w), sum(counts[x] > 0 for x in w), n, round(base, 5)))
    assert sorted((str(r[0]), *tuple(r)[1:5], round(r["base_score"], 5)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(frame(spark, []).limit(0)).count() == 0


def test_trained_model_beats_word_frequencies_on_held_out_texts(spark):
    got = [r for r in QUERIES["op2_lm_scoring"](spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_texts_outside_the_starting_sample_train(spark):
    held = next(i for i in range(100) if remainder(i, 10) == 0)
    kept = next(i for i in range(100) if remainder(i, 10))
    # longer than any text of the starting sample: only the pass over all windows sees it
    rows = [(kept, "one two three " * 60_000, "en", "a", 1), (held, "one two three " * 100, "en", "a", 1)]
    assert len(rows[0][1]) > lm.SAMPLE_CHARS
    got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, rows)).collect()}
    assert got[held]["held_out"] and got[held]["score"] > got[held]["base_score"]


def test_rare_ids_follow_their_context():
    m = tiny_model()
    pairs = [(100, 2000), (200, 2500)]  # each first id is followed by its own id of the tail
    assert all(m.vocabulary.klass[b] == attention.HEAD_CLASSES for _, b in pairs)
    ids = np.array([x for k in np.random.default_rng(4).integers(0, 2, 3000) for x in pairs[k]])
    x, first, y, wanted, _ = next(attention.windows(ids, np.array([0, len(ids)]), together=1 << 20))
    m.train(x, first, y, wanted, steps=200)

    def log_share(a, b):
        x, first, y, wanted, _ = next(attention.windows(np.array([a, b]), np.array([0, 2])))
        return m.log_probabilities(x, first, y)[0, 1]

    assert log_share(100, 2000) > log_share(200, 2000) + 1 and log_share(200, 2500) > log_share(100, 2500) + 1


def test_windows_have_the_full_context():
    assert (attention.CONTEXT, attention.SCORED) == (32, 32) and attention.HEADS == 2


def test_steps_touch_only_the_tail_classes_of_a_batch():
    """Rows that wait for their moves end where Adam on all weights in every step ends."""
    rng = np.random.default_rng(6)
    plain, m = tiny_model(), tiny_model()
    adam, mean, square = attention.Adam(m), {}, {}
    touched = set()
    for step in range(1, 40):
        # a few ids of the tail, in every third step
        ids = rng.integers(0, 1000, 150)
        ids[:4] = rng.integers(1100, 2900, 4) if step % 3 == 1 else ids[:4]
        x, first, y, wanted, _ = next(attention.windows(ids, np.array([0, 70, 150])))
        assert len(x) == 6
        grads = plain._gradients(x, first, y, wanted)
        grads["emb"][-1] = 0
        for k, g in grads.items():
            mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
            square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
            plain.p[k] -= (0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        _, rows = m._touched_gradients(x, first, y, wanted, adam.catch_up)
        assert len(rows) <= len(np.unique(y[wanted])) and len(rows) < attention.TAIL_CLASSES
        touched |= set(rows.tolist())
        adam.learn(x, first, y, wanted, 0.003)
    adam.finish()
    assert len(touched) > 5
    for k, v in plain.p.items():
        was = tiny_model().p[k]
        # the small constant under Adam's division stands still while a row waits
        assert np.quantile(np.abs(v - m.p[k]), 0.999) < 1e-3 and np.abs(v - was).max() > 0.02, k
        assert np.corrcoef((v - was).ravel(), (m.p[k] - was).ravel())[0, 1] > 0.9999, k


def test_bounded_and_shifted_attention_agree():
    rng = np.random.default_rng(7)
    logits, rel = rng.normal(0, 3, (5, attention.SCORED, attention.WIDTH)).astype(np.float32), rng.normal(0, 1, (attention.SCORED, attention.WIDTH)).astype(np.float32)
    safe, shifted = (attention._attended(logits.copy(), rel, np.array([0, 3]), way) for way in (True, False))
    safe, shifted = (a / a.sum(axis=2, keepdims=True) for a in (safe, shifted))
    assert np.allclose(safe, shifted, rtol=1e-4) and (safe[0, :, :attention.CONTEXT] == 0).all() and (safe[:, attention._FUTURE] == 0).all()


def test_packed_counts_may_be_large():
    n = np.array([0, 1 << 28, (1 << 35) + 5, (1 << 62) + 3, 1])
    assert (lm.unpacked(lm.packed(n)) == n).all()


def test_sums_over_equal_keys():
    rng = np.random.default_rng(8)
    for keys in (np.zeros(1, np.uint16), np.arange(5)[::-1].copy(), np.minimum(rng.geometric(0.02, 700), 300).astype(np.uint16), np.repeat(np.arange(3), [1, 90, attention._Groups.ROUNDS])):
        values = rng.integers(0, 100, (len(keys), 3)).astype(np.float32)
        groups = attention._Groups(keys)
        got = dict(zip(groups.keys.tolist(), groups.sums(values).tolist(), strict=True))
        assert got == {k: values[keys == k].sum(axis=0).tolist() for k in np.unique(keys).tolist()}


def test_a_step_projects_each_symbol_once(monkeypatch):
    """Inputs that come again and again add nothing to what is multiplied by the embeddings' weights."""
    m, seen = tiny_model(), []
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    groups = attention._Groups
    monkeypatch.setattr(attention, "_Groups", lambda keys: seen.append(groups(keys)) or seen[-1])
    ids = np.tile([5, 6, 7], 400)
    x, first, y, wanted, _ = next(attention.windows(ids, np.array([0, len(ids)])))
    grads = m._gradients(x, first, y, wanted)
    assert len(seen[0].keys) == 5  # the three ids, the end and what lies before a text
    assert np.count_nonzero(np.abs(grads["emb"]).sum(axis=1)) <= 5


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """Training and scoring read the ids of the word table; no block encodes its words anew."""
    rows = [(i, "alpha beta gamma " * 40, "en", "a", 1) for i in range(30)]
    monkeypatch.setattr(attention, "STEPS", 5)
    plan = lm.score_documents(frame(spark, rows), block_bytes=2000)
    seen = []
    monkeypatch.setattr(lm, "encoder", lambda: seen.append(1))
    block = {"held": [False, True], "sizes": [2, 1], "numbers": lm.packed(np.array([0, 1, 1])), "lengths": lm.packed(np.array([1, 2])), "ids": np.array([40, 41, 42], "<u2").tobytes()}
    import pyarrow as pa

    ((x, first, y, wanted, _),) = lm._block_windows(iter([pa.RecordBatch.from_pylist([block])]))
    assert y[wanted].tolist() == [40, 41, 42, attention.END] and not seen
    assert {r["doc_id"] for r in plan.collect()} == set(range(30))
