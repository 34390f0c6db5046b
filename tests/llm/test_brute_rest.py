"""Whole queries against plain statements: language, media, urls, quality, personal data, and the pipeline's last stages."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference_pii import base, luhn
from test_mixing import plain_mix
from test_sharding import plain_shard

import corpus_pipeline as pipeline
from sparkloom.llm import language, media, pii, quality, urls
from sparkloom.llm.sharding import grown, standard_tree

DOCS = "doc_id long, text string, lang string, source string"


def letter(point):
    raw = hashlib.shake_256(f"letters-1|{point}".encode()).digest(128)
    return [1 if raw[i // 8] >> (7 - i % 8) & 1 else -1 for i in range(1024)]


def plain_vector(text, cache={}):
    symbols = [32]
    for c in (text or "").lower():
        s = ord(c) if c.isalpha() else 32
        if s != 32 or symbols[-1] != 32:
            symbols.append(s)
    symbols += [32] if symbols[-1] != 32 else []
    out = [0] * 1024
    for trigram, n in Counter(zip(symbols, symbols[1:], symbols[2:], strict=False)).items():
        if trigram not in cache:
            a, b, c = map(letter, trigram)
            cache[trigram] = [a[i - 2] * b[i - 1] * c[i] for i in range(1024)]
        out = [x + n * y for x, y in zip(out, cache[trigram], strict=True)]
    return out


def test_language_equals_prototypes_and_cosines(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sees a dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("dog and cat", None), ("Katze, Hund!", None), ("chien 12", "fr"), ("été", None), ("...", "en"), (None, "de"), ("same", "aa"), ("same", "zz")] * 5)]
    learned = [r for r in rows if r[2] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sums = defaultdict(lambda: [0] * 1024)
    for _, t, lang in learned:
        sums[lang] = [x + y for x, y in zip(sums[lang], plain_vector(t), strict=True)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for d, t, _ in rows:
        v = plain_vector(t)
        cosines = {lang: sum(x * y for x, y in zip(v, p, strict=True)) / norm(p) / norm(v) for lang, p in sums.items()} if norm(v) else {}
        best = min(cosines, key=lambda lang: (-round(cosines[lang], 9), lang), default="und")
        assert got[d]["lang_pred"] == best and got[d]["score"] == pytest.approx(max(0.0, cosines.get(best, 0.0)), abs=1e-8), (d, t)
    assert {r["lang_pred"] for d, r in got.items() if rows[d][1] == "same"} == {"aa"}


def test_media_features_of_planted_texts(spark):
    pdf = "%PDF-1.4\nstartxref\n0\n%%EOF"
    bmp = "BM" + "".join(map(chr, [58, 0, 0, 0, 0, 0, 0, 0, 54, 0, 0, 0, 40, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 24])) + "\0" * 29
    texts = [pdf, "x" + pdf, pdf + pdf, "%PDF-x %%EOF", bmp, "é" + bmp, "PK\3\4 PK\5\6", "GIF89a;", "", None, "RIFF\4\0\0\0WAVE"]
    rows = {r["doc_id"]: r["feature"] for r in media.media_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        found = []
        for m in re.finditer(rb"%PDF-(?=[0-9])", payload):
            end = payload.find(b"%%EOF", m.start())
            if end >= 0 and payload.find(b"startxref", m.start(), end) >= 0:
                found.append(("application/pdf", m.start(), end + 5))
        for m in re.finditer(b"BM", payload):
            s = m.start()
            n = int.from_bytes(payload[s + 2 : s + 6], "little")
            if payload[s + 6 : s + 10] == b"\0\0\0\0" and payload[s + 10 : s + 18] == b"\x36\0\0\0\x28\0\0\0" and payload[s + 26 : s + 28] == b"\1\0" and 54 < n and s + n <= len(payload):
                found.append(("image/bmp", s, s + n))
        found.sort(key=lambda x: (x[1], -x[2], x[0]))
        first = next((k for k, s, _ in found if s == 0), "text/plain")
        want = f"audio/wav@0+{len(payload) + 44};text/plain>{first}" + "".join(f";{k}@{s + 44}+{e - s}" for k, s, e in found)
        assert rows[i] == want, (i, rows[i], want)


def plain_margin(model, url, host, path):
    labels = host.split(".")
    query = url.partition("?")[2].partition("#")[0]
    counts = Counter(url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()) if url else 0.0
    rate = lambda name: model.suffix.get(name, model.prior)
    x = [len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), entropy, query.count("="), len(query), len(labels), url.count("-"), float(url.startswith("https")), rate(labels[-1]), rate(".".join(labels[-2:]))]
    total = model.base
    for tree in model.trees:
        at = 0
        while tree[at][0] >= 0:
            at = tree[at][2] if x[tree[at][0]] <= tree[at][1] else tree[at][3]
        total += tree[at][4]
    return total


def test_url_verdicts_are_those_of_the_trees(spark):
    rows = [(f"http{'s' * (i % 2)}://h{i % 9}.{'org' if i % 4 else 'com'}/{'ab-' * (i % 5)}{i % 13}?q={i % 3}", bool(i % 13 > 6 or i % 9 == 2)) for i in range(600)]
    parts = [(u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0]) for u, _ in rows]
    model = urls.fit([u for u, _ in rows], [h for h, _ in parts], [p for _, p in parts], [b for _, b in rows])
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, rules=(), labelled=spark.createDataFrame(rows, "url string, blocked boolean")).collect()}
    for i, (u, _) in enumerate(rows):
        margin = plain_margin(model, u, *parts[i])
        assert got[i]["block_score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-6)
        assert abs(margin) < 1e-6 or got[i]["verdict"] == ("block" if margin > 0 else "allow")


def test_no_url_tells_the_trees_its_own_label():
    # Every url has a site of its own: in-sample rates would be the labels themselves.
    names = [f"http://s{i}.com/{i * 7919 % 1000}" for i in range(2000)]
    labels = [hashlib.md5(n.encode()).digest()[0] % 2 == 1 for n in names]
    hosts, paths = [n.split("/")[2] for n in names], ["/" + n.rsplit("/", 1)[1] for n in names]
    model = urls.fit(names[:1500], hosts[:1500], paths[:1500], labels[:1500])
    x = model.features(names[1500:], hosts[1500:], paths[1500:])
    assert 0.4 < ((model.margin(x) > 0) == labels[1500:]).mean() < 0.6
    sites = {tree[0][0] for tree in model.trees if tree[0][0] >= 0}
    assert urls.FEATURES.index("site_blocked") not in sites


def plain_features(text):
    text = text or ""
    n, words, lines = len(text), text.split(), text.split("\n")
    if not n:
        return [0.0] * 14
    ascii_counts = Counter(c for c in text if ord(c) < 128)
    of = lambda cs: sum(ascii_counts[c] for c in cs)
    lower = of(map(chr, range(97, 123))) + sum(ord(c) >= 192 for c in text)
    entropy = -sum(k / n * math.log(k / n) for k in ascii_counts.values())
    return [
        math.log1p(n) / 10, math.log1p(len(words)) / 8, of(map(chr, range(65, 91))) / n, lower / n, of(quality.SYMBOLS) / n * 5, of("0123456789") / n * 5, of(" ") / n * 3, n / max(1, len(words)) / 10,
        len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 6, of("!?") / max(1, len(words)), of("|") / max(1, len(words)), entropy / 4,
    ]


def test_quality_posteriors_and_scores(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts}
    x = np.array([plain_features(texts[i]["text"]) for i in sorted(y)])
    known = np.array([y[i] for i in sorted(y)], float)
    beta = quality.fit(x, known)
    z = np.hstack([np.ones((len(x), 1)), x, x**2])
    # At the optimum the gradient of the penalised likelihood is nothing.
    assert np.abs(z.T @ (known - 1 / (1 + np.exp(-z @ beta))) - 0.01 * beta).max() < 1e-5
    margins = {i: float(np.concatenate([[1.0], f, np.square(f)]) @ beta) for i, f in ((i, np.array(plain_features(r["text"]))) for i, r in texts.items())}
    odds = lambda p: math.log(p / (1 - p))
    own = {i: min(max(1 / (1 + math.exp(-m)), 0.01), 0.99) for i, m in margins.items()}
    site = {i: (r["source"] or "-", f"{r['source'] or '-'}/{r['lang'] or '-'}") for i, r in texts.items()}

    def summed(level):
        good, n = defaultdict(float), Counter()
        for i, p in own.items():
            good[site[i][:level]] += p
            n[site[i][:level]] += 1
        return good, n

    def strength(good, n, prior):
        units = [k for k in n if n[k] > 1]
        var = {k: prior[k] * (1 - prior[k]) for k in units}
        spread = sum(n[k] * (good[k] / n[k] - prior[k]) ** 2 for k in units)
        weight = sum(n[k] * var[k] for k in units) - sum(var.values())
        rho = max((spread - sum(var.values())) / weight, 1e-9) if weight else None
        return min(max(1 / rho - 1 if rho else 1000.0, 2.0), 1000.0)

    good, n = summed(1)
    top = sum(good.values()) / sum(n.values())
    k = strength(good, n, dict.fromkeys(n, top))
    hosts = {h: (good[h] + k * top) / (n[h] + k) for h in n}
    good, n = summed(2)
    k = strength(good, n, {p: hosts[p[:1]] for p in n})
    paths = {p: (good[p] + k * hosts[p[:1]]) / (n[p] + k) for p in n}
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        assert r["host_share"] == pytest.approx(hosts[site[i][:1]], abs=2e-5) and r["path_share"] == pytest.approx(paths[site[i]], abs=2e-5)
        score = 1 / (1 + math.exp(-(margins[i] + 0.5 * (odds(paths[site[i]]) - odds(top)))))
        assert r["score"] == pytest.approx(score, abs=1e-4) and r["doc_score"] == pytest.approx(1 / (1 + math.exp(-margins[i])), abs=1e-4)


def plain_iban(text):
    lengths = {c: n for n, names in pii.IBAN_LENGTHS.items() for c in names.split()}
    found = []
    for m in re.finditer(r"\b(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2})", text):
        n = lengths.get(text[m.start() : m.start() + 2])
        groups, rest = divmod(n - 4, 4) if n else (None, None)
        shape = rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + rf"(?: ?[A-Z0-9]{{{rest}}})" * bool(rest) if n else r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
        hit = re.compile(shape + r"\b").match(text, m.start())
        if not hit:
            continue
        solid = hit[0].replace(" ", "")
        value = int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4]))
        if 15 <= len(solid) <= 34 and value % 97 == 1:
            own = (m.start(), hit.end(), n is not None)
            if found and found[-1][1] > own[0]:
                if own[2] and not found[-1][2]:
                    found[-1] = own
                continue
            found.append(own)
    return [(a, b) for a, b, _ in found]


def plain_added(text):
    def score(kind, a, b, first):
        around = (text[max(a - 40, 0) : a] + " " + text[b : b + 40]).lower()
        return round(first + 0.3 * bool(re.search(rf"\b(?:{pii.CONTEXT[kind]})\b", around)) - 0.2 * bool(re.search(rf"\b(?:{pii.AGAINST})", around)), 2)

    spans = [("iban", a, b) for a, b in plain_iban(text) if score("iban", a, b, 0.8) >= 0.7]
    ssn = [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
    spans += [("ssn", a, b) for a, b in ssn if score("ssn", a, b, 0.4) >= 0.7]
    shape = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|(?i:passw(?:or)?d|passphrase|pwd|token|secret|api[_-]?key) ?[:=] ?[\"']?([A-Za-z0-9+/_.-]{12,}))"
    for m in re.finditer(shape, text):
        value = m[1] or m[0]
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(set(value)) >= 8 and score("secret", *m.span(), 0.8) >= 0.7:
            spans.append(("secret", *m.span()))
    return spans


def test_added_spans_equal_plain(spark):
    good = ["AT611904300234573201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "XX00ABCD12345678"]
    texts = [f"{a} IBAN {g} {b}" for g in good for a in ("", "é𝄞 my account", "example") for b in ("", "BIC", "EUR 12", ", bank", "X")]
    texts += ["ssn 123-45-6789 and 123-45-67890", "123-45-6789", "x" * 41 + " 123-45-6789 " + "tax id", "tax id " + "y" * 33 + " 123-45-6789", " ".join(good * 60), "AT61AT611904300234573201", "A" * 200 + " " + good[0], "12 " * 21 + good[1], "", None]
    token = hashlib.sha1(b"x").hexdigest()
    texts += [f"the password={token[:18]} is", f'a token = "{token}" b', f"api_key:{token}", f"secret: {token} sample", f"login secret: {token} sample", "password=aaaaaaaaaaaaaaaaaaaa", "token = 12345678901234", "xtoken=" + token, "AKIA" + "Q7ER2YUIOP3SDFGH", "AKIA" + "Q7ER2YUIOP3SDFGHX", "ghp_" + token, "PWD=" + token + "é", "token =  " + token]
    texts += ["card 4111 1111 1111 1111, " + good[0] + " mail a@b.co"] * 2
    rows = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as pii", "2 as pii_text", "3 as pii_iban")).collect()}
    fired = 0
    for i, t in enumerate(texts):
        added = plain_added(t or "")
        fired += len(added)
        want = ",".join(filter(None, [base(t)[1], *(f"{k}:{a}:{b}" for k, a, b in added)]))
        assert rows[i]["spans"] == want and rows[i]["n_spans"] == want.count(":") // 2, (i, t)
    assert fired > 300 and luhn("4111111111111111")


def test_last_stages_of_the_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 120").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 3"))
    key = lambda r: f"{r['doc_id']}|{hashlib.sha256(r['text'].encode()).hexdigest()[:32].upper()}"
    held = {key(r): r for r in docs.collect()}
    taken = {x[0] for x in plain_mix([(k, r["text"], r["lang"], r["source"]) for k, r in held.items()], 0.8, 1)}
    got = pipeline.mixed(spark, docs.dropDuplicates(["doc_id"]), sf_dir).collect()
    assert {key(r) for r in got} == taken and 0 < len(taken) < len(held)
    last = pipeline.sharded(spark, docs, sf_dir).collect()
    tree = standard_tree(8)
    assert len(last) == docs.count() and all(r["shard"] == plain_shard(r["doc_id"], tree) and r["grown_shard"] == plain_shard(r["doc_id"], grown(tree)) for r in last)
    slots = defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
