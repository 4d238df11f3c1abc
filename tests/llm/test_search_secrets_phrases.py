"""op11, op12 and op13 against brute-force versions, and the edge cases that their docstrings define."""

import collections
import math
import random
import re
import string

import numpy as np

from quillmill.llm import collocations, lexical_search, secret_novelty

DOCS = "doc_id long, text string, lang string, source string, seg long, term string, w int, piece string, c long"


def documents(spark, rows):
    """Documents with extra columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, "p", 3) for i, t, lang in rows], DOCS)


# op11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t, _ in docs if i is not None and terms(t)]
    n_docs, n_tokens = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in words if t in bag)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search(docs, items, k):
    return sorted(tuple(r) for r in lexical_search.lexical_search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect())


def test_lexical_search(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Élan", "naïve", "ÀB", "x-y", "a_b", "日本語"]
    pick = lambda n: " ".join(vocab[min(int(rng.expovariate(0.08)), len(vocab) - 1)] for _ in range(n))
    docs = [(i, pick(rng.randint(1, 60)), "en") for i in range(700)]
    docs += [(1000 + i, docs[3][1], "en") for i in range(80)]  # ties
    docs += [(2000, None, None), (2001, "", "en"), (2002, " .,- ", "en"), (None, pick(30), "en"), (5, docs[5][1], "en"), (2003, "word " * 30_000 + "w1 w50", "en")]
    items = [(i, pick(rng.randint(1, 25))) for i in range(30)] + [(100, None), (101, "..."), (102, "nowhere"), (None, "w1"), (3, "w1 naïve ÉLAN"), (103, "W1 w1 W1"), (104, docs[3][1])]
    want = ranked(docs, items, 10)
    table, asked = documents(spark, docs), spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id long")
    assert search(table, asked, 10) == want
    # several segments a task, blocks of a few documents, several blocks of queries, an index of all terms
    for name, value in (("BLOCK", 4), ("SEG_TOKENS", 2000), ("QUERY_TERMS", 100), ("RESTRICT", 3), ("FIRST", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    assert search(table, asked, 10) == want
    assert search(table.limit(0), asked, 10) == [] and search(table, asked.limit(0), 10) == []


def test_posting_blocks_stay_closed():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 21, 28, 31)])
    assert (lexical_search.unpacked(lexical_search.packed(values)[0]) == values).all()
    # a rare term decides: most blocks of the frequent one are never opened
    docs, tokens = 20_000, 20_000 * 50
    rows = lexical_search.segment(0, list(range(docs)), [50] * docs, [np.array([0, 0, 1] if i % 4000 == 7 else [0] if i % 9000 == 3 else [0, 2], np.int32) for i in range(docs)], np.array([b"common", b"rare", b"other"], object), docs, tokens).to_pylist()
    norm = lexical_search.length_norm(np.full(docs, 50), docs, tokens)
    post = {r["term"]: lexical_search.Postings(r["docs"], *(np.array(r[c], np.int64) for c in ("firsts", "lasts", "tops", "ends")), np.frombuffer(r["data"], np.uint8), norm) for r in rows if r["term"]}
    lists = [(3, post["common"]), (9000, post["rare"])]
    doc, score, opened = lexical_search.best(lists, docs, 5, 0)
    assert doc.tolist() == [7, 4007, 8007, 12007, 16007] and len(set(score.tolist())) == 1
    assert opened < 0.4 * sum(len(p.lasts) for _, p in lists)
    assert lexical_search.best(lists, docs, 5, int(score[0]) + 1)[0].tolist() == []
    assert lexical_search.best(lists, docs, 5, int(score[0]))[0].tolist() == doc.tolist()


# op12


def found(spark, rows):
    return {(r["doc_id"], i): r for i, r in enumerate(secret_novelty.find_secrets(documents(spark, rows)).collect())}


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_secrets(spark):
    rng = random.Random(7)
    bits = ["password", "PassWd", "token", "Secret", "api_key", "APIKEY", "=", ": ", " = ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef00112233", "x" * 14, "é日", " ", "\n", "pass", "0123456789abcdef0", "ſecret", "toKen", "=="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "en") for i in range(400)]
    rows += [(None, "password=abcdefabcdef1234", "en"), (1, None, None), (2, "", "en"), (2, "token: " + "a" * 200_000, "en"), (3, "é token = 'abcdef012345xyz' AKIAABCDEFGHIJKLMN", "en")]
    got = secret_novelty.find_secrets(documents(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], ",".join(x for x in r["spans"].split(",") if x and not x.startswith("novel"))) for r in got), key=key) == sorted(((i, ",".join(plain_spans(t))) for i, t, _ in rows), key=key)
    for r in got:
        assert r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_novel"] == len([x for x in r["spans"].split(",") if x])
    assert found(spark, []) == {}


def test_novel_secrets(spark):
    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    words = ["connection", "settings", "handler", "request", "response", "manager", "database", "timeout", "session", "configuration", "default", "environment"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    planted, clean = {}, {}
    for i in range(150):
        kind = i % 5
        key = [draw(string.ascii_letters + string.digits, 24), "ghp_" + draw(string.ascii_letters + string.digits, 36), draw(string.ascii_letters + string.digits + "+/", 43) + "=", draw(string.ascii_lowercase + string.digits, 20), draw(string.ascii_letters + string.digits + "!@$%", 16) + "x1"][kind]
        lead = ["authorization: Bearer ", "use ", "private_key ", "login with ", "pwd "][kind]
        planted[i] = prose(20) + "\n" + lead + key + "\n" + prose(20), key
    for i in range(150, 400):
        clean[i] = prose(15) + rng.choice(["\nthe login handler_request_manager ", "\nauth: database-connection-timeout ", "\npasscode configuration.default.environment ", "\nkey SessionRequestManagerHandler ", "\n"]) + prose(15) + draw(string.ascii_letters + string.digits, 30)
    got = {i: r for (i, _), r in found(spark, [(i, t, "en") for i, (t, _) in planted.items()] + [(i, t, "en") for i, t in clean.items()]).items()}
    hit = 0
    for i, (text, key) in planted.items():
        at = text.index(key)
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x]
        hit += any(s <= at + 4 and e >= at + len(key) - 4 for s, e in spans)
    assert hit >= 0.95 * len(planted)
    # random strings far from a sensitive word, and names near one, are left alone
    assert sum(got[i]["n_novel"] > 0 for i in clean) <= 0.02 * len(clean)


# op13


def plain_phrases(docs, least=30, cover=80, first=2000):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang or "und"] += len(w)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in counts.items():
        often = {p: f for p, f in count.items() if f >= least}
        most = collections.Counter()
        for p, f in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    most[p[i : i + n]] = max(most[p[i : i + n]], f)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and not (p in most and 100 * most[p] >= cover * a):
                s, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, words[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def mined(table, **kw):
    return sorted(tuple(r) for r in collocations.collocations(table, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations(spark, monkeypatch):
    rng = random.Random(9)
    vocab = ["the", "of", "new", "york", "city", "île", "ß", "Big", "日本", "a"]
    pick = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " . "]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60)), rng.choice(["en", "fr", None])) for i in range(300)]
    docs += [(900 + i, "The quick brown fox jumps; over", "en") for i in range(45)]  # one piece in many copies
    docs += [(1000 + i, "The quick brown bear", "en") for i in range(5)]
    docs += [(None, None, None), (1, "", "en"), (2, " ?! ", "xx"), (3, "new york " * 20_000, "en"), (4, "one two\x1fthree four" * 3, "fr"), (4, "one two\x1fthree four" * 3, "fr")]
    table = documents(spark, docs)
    want = plain_phrases(docs)
    assert len(want) > 3 and mined(table) == want
    assert len(plain_phrases(docs, 3)) > 100 and mined(table, least=3, first=50) == plain_phrases(docs, 3, 80, 50)
    for name, value in (("RUN_WORDS", 700), ("BUCKET_BYTES", 3000), ("DEAL", 10)):  # many runs, buckets dealt twice
        monkeypatch.setattr(collocations, name, value)
    assert mined(table, least=5, cover=60) == plain_phrases(docs, 5, 60)
    assert mined(table.limit(0)) == []
    assert mined(documents(spark, [(1, None, "en")])) == []
