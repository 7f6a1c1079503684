import collections
import math
import random
import re
import zlib

from tidewater.llm import language_model, quality_model, secret_scan, urls


def test_quality_model_learns(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(r.choice(["buy", "now", "win"] if bad else ["the", "tree", "grows"]) + str(r.randrange(50)) for _ in range(30)), i))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None, 0), (1001, "", 0), (1001, "", 0), (None, "the tree1", 0)]
    labels += [(5, None), (4, 0), (4, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 300]
    assert held and all(zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in held)
    assert sum(x["predicted"] == (x["doc_id"] % 3 != 0) for x in held) >= 0.95 * len(held)


def test_quality_model_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for labels in ([], [(1, 1)]):
        assert quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).first()["score"] == 0.5
    assert quality_model.classify(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_language_model_base_and_gain(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for i in range(200):
        words = ["alpha", "beta", "gamma", "delta"] * r.randrange(1, 12)
        if i % 9 == 0:
            words[r.randrange(len(words))] = f"Rare{i}"
        rows.append((i, " ".join(words), "h"))
    rows += [(500, None, "h"), (501, "", "h"), (501, "", "h"), (None, "alpha beta", "h")]
    monkeypatch.setattr(language_model, "FREQUENT", 40)
    out = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, h string")).collect()
    split = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    counts = collections.Counter(w for d, t, _ in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((d, len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for d, t, _ in rows)
    assert collections.Counter((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in out) == want
    held = [x for x in out if x["held_out"]]
    assert sum(x["score"] for x in held) > 0.6 * sum(x["base_score"] for x in held)


def test_language_model_probabilities_sum_to_one():
    import numpy as np

    v = language_model.Vocabulary(np.arange(1, 3000, dtype=np.uint64) * np.uint64(77777777777), np.arange(3000, 1, -1), 5_000_000, 9000)
    m = language_model.Model(v)
    rows, keys = language_model._contexts(np.array([5, 6, 7], np.uint64), np.array([0, 3]))
    m.load(np.random.default_rng(1).normal(size=len(m.weights())).astype(np.float32))
    place = np.arange(-1, 2999)
    for k in range(3):
        p = 10 ** m.log10_probability(np.repeat(rows[:, k : k + 1], len(place), 1), np.repeat(keys[:, k : k + 1], len(place), 1), place)
        assert abs(p.sum() - 1) < 1e-3


def test_language_model_scores_match_a_slow_reading():
    """Every factor of a few tokens, computed one by one from the definition."""
    import numpy as np

    r = np.random.default_rng(6)
    hashes, counts = r.integers(1, 2**63, 500, dtype=np.uint64), r.integers(1, 4000, 500)
    v = language_model.Vocabulary(hashes, counts, int(counts.sum()) + 100, 600)
    m = language_model.Model(v)
    m.load(r.normal(size=len(m.weights())).astype(np.float32))
    h = np.concatenate((r.choice(hashes, 30), r.integers(1, 2**63, 3, dtype=np.uint64), [language_model.END]))
    rows, keys = language_model._contexts(h, np.array([0, len(h)]))
    place = v.find(h)[0]
    order = sorted(range(500), key=lambda i: (-counts[i], hashes[i]))
    total, before, klass = counts.sum(), 0, []
    for i in order:
        klass.append(min(language_model.CLASSES - 1, int(language_model.CLASSES * (before + counts[i] / 2) / total)))
        before += counts[i]
    for t in range(len(h)):
        own = [order.index(i) for i in range(500) if hashes[i] == h[t]]
        logits = [v.class_bias[c] + sum(m.classes[rows[f, t], c] for f in range(3)) for c in range(language_model.CLASSES + 1)]
        c = klass[own[0]] if own else language_model.CLASSES
        want = logits[c] - math.log(sum(math.exp(x) for x in logits))
        if own:
            members = [p for p in range(500) if klass[p] == c]
            spot, low, node, width = members.index(own[0]), 0, 1, 1 << max(0, len(members) - 1).bit_length()
            while width > 1:
                width //= 2
                right = spot >= low + width
                weigh = lambda a: sum(counts[order[members[q]]] + 0.5 for q in range(a, min(a + width, len(members))))  # noqa: B023, E731
                x = math.log(weigh(low + width) / weigh(low)) if weigh(low + width) else -60.0
                place_ = int(v.base[c]) + node
                for f in range(3):
                    salted = (int(keys[f, t]) ^ place_ * 0xD1342543DE82EF95 % 2**64) * 0x9E3779B97F4A7C15 % 2**64
                    x += float(m.halves[salted >> (64 - language_model.BITS)])
                want += -math.log1p(math.exp(-x if right else x))
                low, node = low + width * right, 2 * node + right
        got = m.log10_probability(rows[:, t : t + 1], keys[:, t : t + 1], place[t : t + 1])[0]
        assert abs(got - want / math.log(10)) < 1e-4


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = language_model.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def test_urls(spark):
    given = ["http://a.example.net/en/1", "https://X.NET/q", "http://example.com/de/5?x", "http://b.example.com/fr/5", "http://q.org/fr/", "http://q.org/de/", None, "no scheme", "a://b", "ftp://notnet/x", "http://h.net?x/", "", "http://u/p#f"]
    rows = [(i, u, "clash") for i, u in enumerate(given)] + [(0, given[0], "clash")] + [(100 + i, f"http://s{i}.example.net/en/a{i}", "") for i in range(40)] + [(200 + i, f"http://bad{i}.net/xx/{i}", "") for i in range(40)]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert [out[i]["host"] for i in range(13)] == ["a.example.net", "x.net", "example.com", "b.example.com", "q.org", "q.org", "", "", "b", "notnet", "h.net", "", "u"]
    assert [out[i]["path"] for i in range(13)] == ["/en/1", "/q", "/de/5", "/fr/5", "/fr/", "/de/", "", "", "", "/x", "", "", "/p"]
    assert [out[i]["rule"] for i in range(13)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None, None]
    assert [out[i]["verdict"] for i in (0, 1, 2, 4)] == ["allow", "block", "block", "allow"]
    assert out[6]["verdict"] == out[11]["verdict"] == "allow"
    assert all(r["verdict"] in ("allow", "block") for r in out.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secrets(spark):
    r = random.Random(3)
    key = lambda n, a="0123456789abcdef": "".join(r.choice(a) for _ in range(n))
    spread = "-".join(key(8) for _ in range(4))
    texts = [f'see token = "{key(40)}" here' for _ in range(60)] + [None, "", "PASSWORD: abcde", "Password='abcdef'", f"AKIA{key(16, 'ABCDEFGH2345')} x", f"é {key(24)}", "plain words only_here", f"free {key(20)} end", f"code {spread}", "1234567890123456"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, n_chars long")
    models = secret_scan.learn(docs)
    out = {x["doc_id"]: x for x in secret_scan.scan(docs, models).collect()}
    assert (out[0]["n_assign"], out[0]["n_hex"], out[0]["n_access"]) == (1, 1, 0)
    assert out[0]["spans"] == "assign:4:53,hex:13:53"
    assert [out[60 + i]["spans"] for i in range(4)] == ["", "", "", "assign:0:16"]
    assert out[64]["n_access"] == 1 and out[65]["spans"] == "hex:2:26"
    assert out[66]["spans"] == "" and out[69]["spans"] == ""
    assert out[67]["spans"] == "format:5:25"  # as likely as the labelled ones, though no pattern has it
    clean = {x["doc_id"]: x for x in secret_scan.redact(docs, models).collect()}
    assert clean[0]["text"] == 'see token = "[REDACTED]" here' and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[66]["text"] == texts[66] and clean[66]["n_chars"] == 5 and clean[60]["text"] is None
    assert secret_scan.scan(docs.where("false"), []).count() == 0


def test_automaton_merges_and_scores():
    r = random.Random(5)
    a = secret_scan.Automaton(["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)])
    assert len(a.states) < 10
    assert a.score("0f1e2d3c4b5a69788796a5b4") > a.score("an_ordinary_name_2024") + 2


def test_spans_of_formats_keep_off_taken_ones():
    class Any:
        def score(self, s):
            return 1.0

    r = random.Random(8)
    for _ in range(200):
        text = " ".join("".join(r.choice("ab01") for _ in range(r.randrange(10, 24))) for _ in range(12))
        taken = sorted((a, a + r.randrange(1, 60)) for a in r.sample(range(len(text)), 4))
        found = [m.span() for m in secret_scan.CANDIDATE.finditer(text) if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group())]
        assert secret_scan.format_spans(text, [(Any(), 0.0)], taken) == [(x, y) for x, y in found if not any(a < y and x < b for a, b in taken)]
