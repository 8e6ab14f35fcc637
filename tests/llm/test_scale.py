"""Hot keys, large counts, edges of the operators' methods, each against a plain version."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, embed_dedup, html_text, mixing, ngram_lm, pseudonyms, secrets, simhash, toxicity
from tests.llm.test_operators import brute_components, luhn, random_text

# 1


def plain_battery(token):
    """Encoding, the three tests' z-values, and the one against structured text."""
    body = token.rstrip("=")
    which = next((k for k, (_, p, _, _) in enumerate(secrets.ENCODINGS) if re.fullmatch(p, body)), len(secrets.ENCODINGS))
    alphabet, rate = (secrets.ENCODINGS[which][2], secrets.ENCODINGS[which][3]) if which < len(secrets.ENCODINGS) else (string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_", 0.06)
    x, n, k = np.array([alphabet.index(c) for c in body], float), len(body), len(alphabet)
    chi = sum(v * v for v in np.unique(x, return_counts=True)[1]) * k / n - n
    df = k - 1
    uniform = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    high = x * 2 >= k
    a, b = high.sum(), (~high).sum()
    runs = 1 + (high[1:] != high[:-1]).sum()
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (runs - mean) / np.sqrt(var) if var > 0 else 99.0
    d = x - x.mean()
    z_serial = (d[:-1] * d[1:]).sum() / (d * d).sum() * np.sqrt(n) if (d * d).sum() else 99.0
    delta = k * rate - 1
    return which, uniform, z_runs, z_serial, (df + n * delta - chi) / np.sqrt(2 * (df + 2 * n * delta))


def tail(z):
    from math import erfc, sqrt

    return erfc(z / sqrt(2)) / 2


def test_battery_against_a_plain_version(spark):
    rng = random.Random(3)
    alphabets = ["0123456789", "0123456789abcdef", string.ascii_lowercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + "-_", string.ascii_uppercase + "234567"]
    words = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for a in alphabets for _ in range(12)] + ["abcd" * 8, "a" * 30, "Zq" * 20, "0123456789" * 3, "helloworldthisisaverylongword"]
    got = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", secrets.tested(F.col("w")).alias("t")).select("i", "t.*").collect()
    for r in got:
        which, uniform, runs, serial, text = plain_battery(words[r.i])
        n = len(words[r.i])
        assert r.stratum == which * (len(secrets.BANDS) + 1) + sum(n >= b for b in secrets.BANDS)
        limits = [tail(uniform), 2 * tail(abs(runs)), 2 * tail(abs(serial))]
        if min(abs(p - 0.001) for p in limits) > 1e-5:
            assert r.random == all(p >= 0.001 for p in limits), words[r.i]
        assert r.bin == pytest.approx(min(50 * -np.log10(max(tail(text), 1e-40)), 2000), abs=1.5)


def test_false_discovery_bounds_against_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice([rng.randrange(0, 120), rng.randrange(0, 1200)])) for s in (1, 2, 7) for _ in range(400)] + [(9, 0)]
    got = secrets.bounds(spark.createDataFrame(rows, "stratum int, bin int"))
    want = {}
    for s in {s for s, _ in rows}:
        bins = sorted((b for t, b in rows if t == s), reverse=True)
        good = [b for b in bins if len(bins) * 10 ** (-b / 50) <= 0.01 * sum(x >= b for x in bins)]
        if good:
            want[s] = min(good)
    assert got == want


def test_tokens_of_one_text_in_any_number(spark):
    rng = random.Random(7)
    tokens = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(3000)]
    text = "é" + " ".join(tokens)
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("spans").first()[0]
    found = {text[s.start : s.end] for s in spans}
    assert found <= set(tokens) and len(found) > 2900 and [s.start for s in spans] == sorted(s.start for s in spans)


# 2


def test_counts_beyond_32_bits(tmp_path):
    counts = np.array([1, 2, 5, 1 << 33, (1 << 40) + 7, 300], np.int64)
    words = np.array([2, 4, 6, 8, 10, 12], np.uint64)
    blob = ngram_lm._squeeze([words, words, counts])
    columns = ngram_lm._unsqueeze([blob, blob], 3)
    assert (columns[2] == np.tile(counts, 2)).all()
    merged = ngram_lm._merge_grams(str(tmp_path), 2, 1)(pa.table({"part": pa.array([0, 0], pa.int32()), "blob": [blob, blob]}))
    key = ngram_lm._fold([words, words])
    assert (ngram_lm._find(f"{tmp_path}/grams-2/0", key, 1)[:, 0] == 2 * counts).all()
    assert (ngram_lm._find(f"{tmp_path}/contexts-2/0", ngram_lm._fold([words]), 4)[:, 0] == 2 * counts).all()
    assert merged.column("kind").to_pylist()[0] == "stats" and not ngram_lm._find(f"{tmp_path}/grams-2/0", key ^ np.uint64(1 << 40), 1).any()


def test_hash_table_with_many_keys_and_rows(tmp_path):
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    values = [rng.integers(0, 40, len(key)), rng.integers(0, 1 << 35, len(key)) * (rng.random(len(key)) < 0.02), rng.integers(0, 3, len(key))]
    ngram_lm._save_table(f"{tmp_path}/t", key, values)
    assert (ngram_lm._find(f"{tmp_path}/t", key, 3) == np.stack(values, axis=1)).all()
    assert not ngram_lm._find(f"{tmp_path}/t", key ^ np.uint64(1 << 40), 3).any() and not ngram_lm._find(f"{tmp_path}/none", key, 3).any()


# 3


def test_class_words_and_breaks():
    assert html_text.main_text('<article><p>super<wbr>cali</p><p class="related">the related facts</p><p>a<img src=x>b<br>c</p></article>') == "supercali the related facts ab c"
    page = '<body><div class="related"><p>Other things, a long line of them, that has nothing to do with it at all.</p></div><article><p>Text.</p><div class="share">Share it</div></article></body>'
    assert html_text.main_text(page) == "Text."
    deep = "<b>" * 20_000 + "<p>x</p>" * 5000 + "<div>" * 20_000
    assert html_text.main_text(deep).startswith("x x")


def plain_regions(weights, window, surge):
    """Runs of lines from a surge of the window's sum to its dive to nothing."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    kept, inside = [], False
    for i, s in enumerate(sums):
        inside = s > 0 if inside else bool(weights[i]) and s >= surge
        if inside and weights[i]:
            kept.append(i)
    return kept


def test_line_blocks_against_a_plain_version():
    rng = random.Random(12)
    changed = 0
    for _ in range(300):
        lines = [f"L{i} " + "x" * rng.choice([0, 3, 40, 120]) if rng.random() < 0.6 else None for i in range(rng.randint(1, 25))]
        page = "<body>" + "".join(f"<p>{t}</p>" if t else "<nav>menu</nav>" for t in lines) + "</body>"
        out = {}
        for window, surge in ((1, 30), (3, 86), (5, 200)):
            weights = [len(t.strip()) if t else 0 for t in lines]
            kept = plain_regions(weights, window, surge) or plain_regions(weights, window, 1)
            out[window] = html_text.main_text(page, html_text.Distribution(window, surge))
            assert out[window] == " ".join(lines[i].strip() for i in kept)
        changed += len(set(out.values())) > 1
    assert changed > 100  # window and surge decide


# 4


def converged(n, p, weights):
    """Totals of a plain projected gradient, run until it stands still."""
    goal = np.array(weights) / sum(weights) * n.sum()
    a = (n[:, None] * p).T / np.sqrt(n)  # rates scaled by the root of the tokens
    y, step = np.sqrt(n), 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(200_000):
        new = np.maximum(y - step * (a.T @ (a @ y - goal)), 0)
        if np.abs(new - y).max() < 1e-13 * max(1, np.abs(y).max()):
            break
        y = new
    return a @ y, goal


@pytest.mark.parametrize("seed", [0, 1])
def test_rates_reach_the_least_squares(spark, seed):
    rng = np.random.default_rng(seed)
    n, p = rng.integers(5, 40, 5 + 20 * seed).astype(float), rng.dirichlet([1, 1, 1], 5 + 20 * seed)
    df = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p)], "n long, a double, b double, c double")
    for weights in ((1, 0, 0), (0, 1, 0), (0.02, 0.97, 0.01), (0.4, 0.3, 0.3))[: 4 - seed]:
        got = mixing.fit_rates(df, "n", ["a", "b", "c"], list(map(float, weights)))
        best, goal = converged(n, p, weights)
        assert got.converged and ((np.array(got.totals) - goal) ** 2).sum() <= ((best - goal) ** 2).sum() + 1e-3
        rates = [r[0] for r in df.select(got.rate([F.col(c) for c in "abc"])).collect()]
        assert min(rates) >= 0 and (np.array(rates) * n) @ p == pytest.approx(got.totals, abs=1e-6)


def test_domains_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "d e", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, "good")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="poor"):
        out, model, rates = mixing.mix(docs, labels, {"good": 0.5, "poor": 0.5})
    assert {r.p_poor for r in out.collect()} == {0.0} and rates.targets == (2.5, 2.5) and rates.totals[1] == 0
    with pytest.warns(UserWarning):
        out, _, _ = mixing.mix(docs.withColumnRenamed("lang", "symbols"), labels.limit(0), {"good": 0.5, "poor": 0.5}, categories=("symbols",))
    assert {(r.p_good, r.rate) for r in out.collect()} == {(0.5, 1.0)}
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {})


# 5


def test_values_among_others(spark):
    how = pseudonyms.Pseudonyms("k")
    card = "4111 1111 1111 1111"
    texts = [
        f"card {card} 12/25", f"7 {card}", f"{card} 5500 0000 0000 0004", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", f"2024 {card} 99", "tel +33 1 23 45 67 89, +33 12 34 56 78 90.",
        "DE89370400440532013000 and 192.168.1.77 and 078-05-1120 on 24.12.1999", "x.y@a-b.example.org x.y@a-b.example.org",
    ]
    got = {r.doc_id: r.text for r in pseudonyms.report(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), how).collect()}
    assert "4111" not in got[0] and got[0].endswith(" 12/25") and luhn(re.sub(r"\D", "", got[0][5:24]))
    assert got[1].startswith("7 ") and "4111" not in got[1]
    a, b = got[2][:19], got[2][20:]
    assert luhn(a.replace(" ", "")) and luhn(b.replace(" ", "")) and "4111" not in a and "5500 0000" not in b
    assert got[0][5:24] == got[1][2:] == a == got[4][5:24] and got[4][:5] == "2024 " and got[4][24:] == " 99"
    assert got[3] == texts[3]
    assert re.fullmatch(r"tel \+33 \d( \d\d){4}, \+33( \d\d){5}\.", got[5]) and not {"23 45 67 89", "34 56 78 90"} & set(re.findall(r"\d\d \d\d \d\d \d\d", got[5]))
    iban, ip, ssn, date = re.fullmatch(r"(DE\w{20}) and ([\d.]+) and (\d{3}-\d{2}-\d{4}) on (\d\d\.\d\d\.\d{4})", got[6]).groups()
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and all(int(x) < 256 for x in ip.split("."))
    assert ssn[:3] not in ("000", "666") and ssn != "078-05-1120" and 1900 <= int(date[6:]) < 2100 and "1999" not in got[6].split(" on ")[0]
    x, y = got[7].split()
    assert x == y != "x.y@a-b.example.org" and x.endswith("@a-b.example.org")


# 6


def test_hot_routing_keys_are_split(spark):
    rng = np.random.default_rng(6)
    ball = simhash.Ball()
    fp = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    hot = sum(1 << p for p in ball.positions()[:16])
    fp[:450] &= np.uint64(2**64 - 1 - hot)  # half of all share the first sixteen routing bits
    fp[450:470] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64))
    fp = np.unique(fp)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = simhash.links(df, ball, home=2).collect()
    root = brute_components(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4])
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert all(int(fp[at[r.a]] ^ fp[at[r.b]]).bit_count() <= 4 for r in got)
    assert brute_components(range(len(fp)), [(at[r.a], at[r.b]) for r in got]) == root and len(set(root.values())) < len(fp)
    n = ball.route_bits(len(fp), 2)
    most, hot, sizes = 4 * 2 * ball.copies(n), frozenset(), []
    for _ in range(16):
        rows, key, left = ball.routes(fp, n, hot)
        keys, often = np.unique(key, return_counts=True)
        sizes.append(often.max())
        assert (left >= 0).all() and not np.isin(keys, list(hot)).any()
        if sizes[-1] <= most:
            break
        hot |= {int(k) for k in keys[often > most]}
    assert sizes[0] > most >= sizes[-1]


# 7


def test_short_items_tolerate_a_word_and_both_joins_agree(spark):
    items = [(1, "a b c d e f g h"), (2, "one two three four five"), (3, "uno dos tres"), (4, " ".join(f"w{i}" for i in range(20)))]
    docs = [(1, "x a b q d e f g h y"), (2, "one two nope four five"), (3, "uno nope tres"), (4, "uno dos tres"), (5, " ".join(f"w{i}" if i != 9 else "z" for i in range(3, 20))), (None, "one two three four five"), (5, None), (6, "a b c d " * 3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.score) for r in decontaminate.overlaps(d, b).collect())
    assert [x for x in got if x[0] != "6"] == [("1", 1, 6), ("2", 2, 3), ("4", 3, 3), ("5", 4, 15), ("None", 2, 5)]
    assert sorted(map(str, decontaminate.overlaps(d, b, decontaminate.Seeds(broadcast_bytes=0)).collect())) == sorted(map(str, decontaminate.overlaps(d, b).collect()))
    assert decontaminate.overlaps(d.limit(0), b).count() == 0


# 8


def test_sample_is_bounded_and_ids_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, prior, options: seen.append(texts) or toxicity.Model(None, np.array([float(len(texts)), sum(map(len, texts)), float(toxic.sum())])))
    docs = spark.createDataFrame([(i, "t" * 100, 1) for i in range(50)] + [(1, "s", 1), (1, "t" * 100, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int")
    n, size, _ = toxicity.train(docs, labels, toxicity.Options(per_class=10)).calibration
    assert n == 20 and 1900 <= size <= 2000
    n, size, _ = toxicity.train(docs, labels, toxicity.Options(per_class=10, train_bytes=750)).calibration
    assert size <= 750 and n in (7, 8)
    assert toxicity.train(docs, labels.limit(0), toxicity.Options()).calibration is not None


def test_kernel_and_machine_against_plain_versions():
    u = toxicity.units(np.frombuffer(b"idiot idiiot moron", np.uint8), np.array([0, 18]))
    _, _, _ = unit, feature, weight = toxicity._entries(u)
    vectors = [dict(zip(*[iter(())] * 2)) for _ in range(3)]
    for a, f, w in zip(unit, feature, weight):
        vectors[a][f] = vectors[a].get(f, 0.0) + float(w)
    plain = np.array([[sum(x.get(f, 0) * w for f, w in y.items()) ** 3 for x in vectors] for y in vectors])
    got = toxicity.Landmarks.of(u).kernel(u, np.arange(3))
    assert got == pytest.approx(plain, abs=1e-5) and plain[0, 1] > 0.02 > plain[0, 2]
    rng = np.random.default_rng(0)
    z = np.hstack([rng.normal(size=(80, 3)), np.ones((80, 1))])
    y = np.sign(z[:, 0] + 0.3 * rng.normal(size=80))
    b = toxicity._svm(z, y, np.ones(80), 0.1)
    loss = lambda v: (np.maximum(1 - y * (z @ v), 0) ** 2).sum() + 0.1 * (v[:3] ** 2).sum() + 1e-4 * v[3] ** 2
    assert all(loss(b) <= loss(b + 1e-3 * rng.normal(size=4)) for _ in range(200))


# 9


@pytest.mark.parametrize("cut", [None, 5])
def test_cells_find_every_pair_once(cut):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8)) * 0.125
    x[:50] = x[0] + rng.normal(size=(50, 8)) * 0.02
    budget = 0.14 / 8
    close = {(i, j) for i in range(600) for j in range(i) if ((x[i] - x[j]) ** 2).sum() <= budget}
    found = []
    if cut is None:
        for i, j in embed_dedup.meetings(x, np.arange(600), None, False, budget):
            found += [(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())]
    else:
        half = np.arange(600) % 2 == 0
        for left, right, both in ((np.flatnonzero(half), None, False), (np.flatnonzero(~half), None, False), (np.flatnonzero(half), np.flatnonzero(~half), True)):
            for i, j in embed_dedup.meetings(x, left, right, both, budget):
                found += [(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and close <= set(found)
    assert len(found) < 0.17 * 600 * 599 / 2  # of all pairs, in one block


def test_ids_of_any_type(spark):
    rows = [("b", [1.0, 0.0], "x"), ("a", [1.0, 0.01], "x"), ("c", [0.0, 1.0], "x"), ("a", [1.0, 0.01], "y")]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, "a", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    small = [(i, [float(i), 1.0], 1) for i in range(3)]
    assert embed_dedup.near_duplicates(spark.createDataFrame(small, "vec_id int, embedding array<double>, label int")).count() == 3
