"""The corpus operators on nulls, empty and odd texts, repeated rows and clashing names, against brute force."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, duckdb_rows, spark_rows
from pyspark.sql import functions as F

import public_tokenizers
import tokenizers
import zstandard
from plumbline.llm import common, decontaminate, html_diff, ngram_join, packing, pii, quality_classifier, quality_rules, queries, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "x y z"), (6, "é" * 50), (7, "\x00 \x1c a b")]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("n_words", F.lit(1)).withColumn("path", F.lit("p")).withColumn("length", F.lit("l"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duckdb_rows(queries.SQL[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- decontamination


def test_contamination_with_several_blocks_equals_one(spark, monkeypatch):
    random.seed(1)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.choice([0, 3, 10, 14])))) for k in range(20)] + [(3, "other text"), (None, "w1 w2 w3"), (50, None)]
    texts = []
    for k in range(40):
        inserted = random.choice(items)[1] or ""
        texts.append((k, " ".join(random.choices(vocabulary, k=20)) + ", " + inserted.upper() + "; " + " ".join(random.choices(vocabulary, k=5))))
    d = docs(spark, [*ODD, *texts])
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.find_contamination(d, b, window=4).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    monkeypatch.setattr(decontaminate, "COUNTED_BLOCKS", 3)
    monkeypatch.setattr(decontaminate, "LOAD_BYTES", 500)
    assert sorted(map(str, decontaminate.find_contamination(d, b, window=4).collect())) == one
    assert decontaminate.find_contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.remove_contaminated(d, b.limit(0)).columns == d.columns
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0


def test_contamination_of_short_items_equals_brute_force(spark):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(random.choices(vocabulary, k=n))) for k, n in enumerate([1, 1, 2, 2, 9, 10, 11, 11])] + [(20, "zebra")]
    rows = [*ODD, (90, "a zebra ran"), (91, "zebra"), (92, "A Zebra"), (93, "zebras ran"), (94, "Zebra, a zebra")]
    for k in range(60):
        inserted = items[k % len(items)][1].split()
        before, after = (random.choices(vocabulary[:20], k=random.randint(0, 12)) for _ in "ab")
        rows.append((100 + k, " ".join(before + inserted[: len(inserted) - (k % 5 == 0)] + after)))
    want = []
    for d, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit, names = set(), set()
        for i, text in items:
            b = text.split()
            for g in [b[k : k + 10] for k in range(max(1, len(b) - 9))]:
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit |= set(range(k, k + len(g)))
                        names.add(str(i))
        want.append((str(d), len(w), len(hit), sorted(names)))
    found = decontaminate.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect()) == sorted(want)


# --- n-gram join


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "group"), [(2, 60, 8192), (4, 85, 8192), (2, 60, 3), (3, 80, 8192)])
def test_groups_equal_brute_force(spark, monkeypatch, k, percent, group):
    random.seed(percent + group)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group * 512)
    monkeypatch.setattr(ngram_join, "FAMILY_BYTES", 200 if group == 3 else 1 << 24)
    base = [[random.choice("abcdefghij") + random.choice("xyz") for _ in range(random.choice([6, 30, 80]))] for _ in range(4)]
    rows = list(ODD)
    for d in range(100, 230):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3])):
            w[random.randrange(len(w))] = random.choice(["new", "N", "q"])
        rows.append((d, " ".join(w)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.find_groups(docs(spark, rows), words=k, percent=percent).collect())
    assert got == brute_groups(rows, k, percent)


def test_one_document_of_each_group_stays_and_null_keys_with_it(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a lone text without a key " * 3), (None, long + " end"), (5, long), (3, long + " tail"), (3, "nothing like the other text under its key"), (7, long), (7, long), (8, None), (9, ""), (None, None)]
    rows += [(None, "two texts without any key that are the same"), (None, "two texts without any key that are the same")]
    got = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.keep_one(docs(spark, rows)).collect())
    want = [r for r in rows if r[0] in (3, 8, 9) or (r[0] is None and not (r[1] or "").startswith(long))]
    assert got == sorted((str(d), str(t)) for d, t in want)


def test_no_documents_no_groups(spark):
    empty = docs(spark, [(1, "a")]).limit(0)
    assert ngram_join.find_groups(empty).count() == 0
    assert ngram_join.keep_one(empty).columns == empty.columns


def test_node_pairs_of_a_large_group_are_found():
    random.seed(5)
    sets = [np.unique(np.array([random.getrandbits(62) for _ in range(60)], dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[:-3], np.array([random.getrandbits(62) for _ in range(3)], dtype=np.uint64)])) for s in sets]
    sets.sort(key=len)
    bits = np.zeros((len(sets), 32), dtype=np.uint64)
    for k, s in enumerate(sets):
        for t in s.tolist():
            bits[k, (t % 2048) >> 6] |= np.uint64(1 << (t % 64))
    n = np.array([len(s) for s in sets])
    found = ngram_join.Group(np.arange(len(sets)), n, bits, n, 80, sets).traverse()
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if ngram_join.linked(sets[i], sets[j], 80)}
    assert set(found) == want and len(want) == 60


# --- URL filter


def test_urls(spark):
    model = url_filter.train(spark)
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.ORG/es/1?x"), (4, "https://example.org/en/148.html"), (5, "https://a.casino-jackpots.test/win"), (6, "https://weather-report.test/en/9"), (7, "http://xexample.org"), (8, "https://e.com/de/1#x")]
    rows = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, model, queries.URL_RULES).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/148.html", "example.org/en/1", "block")
    assert (got[5][3], got[6][3]) == ("block", "allow")
    assert got[7][:3] == ("xexample.org", "", None)
    assert got[8][2:] == ("com/de/", "block")


def test_url_classifier_on_hosts_it_has_not_seen(spark):
    model = url_filter.train(spark)
    hosts = [(h, 1) for h in ("mega-casino", "bets-online", "adult-videos", "spam-offers", "cheap-pills-now", "ads-clicker")] + [(h, 0) for h in ("morning-news", "city-library", "thornton", "music-school", "river-stone", "earth-science")]
    rows = spark.createDataFrame([(f"https://www.{h}.test/en/{k}", y) for h, y in hosts for k in range(3)], "url string, y int")
    right = url_filter.judge(rows, model, []).where((F.col("verdict") == "block") == (F.col("y") == 1)).count()
    assert right >= 0.8 * rows.count()


def test_url_grams_and_parts_equal_brute_force(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()] + [None, "", "http://", "HTTP://É.test/ü?a://b", "x://" + "long/" * 40_000]
    rows = spark.createDataFrame([(u,) for u in urls], "host string")  # the URL in a column that is replaced
    model = url_filter.UrlModel(tuple(0.0 for _ in range(url_filter.BUCKETS)), -1.0)
    got = url_filter.judge(rows.repartition(1), model, queries.URL_RULES, url="host").collect()
    assert [(r.host, r.path) for r in got if r.block_probability == 0] == [("", "")] * sum(not u or "://" not in u or u == "http://" for u in urls)
    want = collections.Counter()
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
        want[host, path, best.name if best else None, best.verdict if best else "allow"] += 1
    assert collections.Counter((r.host, r.path, r.rule, r.verdict) for r in got) == want
    grams = spark.createDataFrame([("é.test", "/añ")], "h string, p string").select(url_filter.buckets(F.col("h"), F.col("p")).alias("b")).first().b
    text = "^é.test/añ$"
    assert len(grams) == sum(len(text) - n + 1 for n in url_filter.GRAMS)
    assert url_filter.judge(rows.limit(0), model, queries.URL_RULES, url="host").count() == 0


# --- PII


def feistel(a, b, p, q, key, tweak):
    for i in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{b}|{key}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + h) % (p if i % 2 == 0 else q)
    return a, b


def digits(s, key, kind):
    u = len(s) // 2
    a, b = feistel(int(s[:u] or 0), int(s[u:]), 10**u, 10 ** (len(s) - u), key, f"{kind}{len(s)}")
    return f"{a:0{u}d}" * (u > 0) + f"{b:0{len(s) - u}d}"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10


def test_pseudonyms_equal_brute_force(spark):
    texts = ["card 4845168114407329, again 4845-1681-1440-7329", "not a card 4845168114407328", "call +1 (974) 555-3436 or (974) 555-3436", "ip 97.51.17.173 and 300.1.1.1", "", None, "nothing", "me.too@mail7.example.com ME.TOO@mail7.example.com"]
    got = [r.text for r in pii.pseudonymize(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    body = digits("484516811440732", "k", "card")
    card = next(body + c for c in "0123456789" if luhn(body + c) == 0)
    phone = "9745553436"
    while True:
        phone = digits(phone, "k", "phone")
        if phone[0] >= "2" and phone[3] >= "2":
            break
    a, b = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "k", "address")
    assert got[0] == f"card {card}, again {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}"
    assert got[1] == texts[1]
    assert got[2] == "call +1 ({0}) {1}-{2} or ({0}) {1}-{2}".format(phone[:3], phone[3:6], phone[6:])
    assert got[3] == f"ip {a >> 8}.{a & 255}.{b >> 8}.{b & 255} and 300.1.1.1"
    assert got[4:7] == ["", None, "nothing"]
    assert len(set(got[7].split())) == 1 and "mail7" not in got[7]


def test_dates_and_digits_are_permuted(spark):
    days = spark.range(0, pii.DAYS).select(pii._permute_day(F.col("id"), "k").alias("p"))
    assert tuple(days.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()) == (pii.DAYS, 0, pii.DAYS - 1)
    three = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("p"))
    assert three.distinct().count() == 1000


def test_numbers_and_dates_of_other_formats_get_pseudonyms(spark):
    phones = ["555-123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "+15551234567", "+44 20 7946 0958", "+442079460958", "+49 30 12345678", "+49 (30) 1234-5678", "+33 1 23 45 67 89", "+45 12 34 56 78", "+49 1512 345 67890", "+1 555 1234567"]
    cards = ["3782 822463 10005", "3782-822463-10005", "378282246310005"]
    dates = ["3/4/1985", "1985-3-4", "3.4.1985", "12/31/1999", "31/12/1999", "1/31/2000"]
    left = ["555-1234", "31/31/1999", "13/13/1999", "1985-13-4", "3782 822463 10006", "+12 345", "1-2-3", "10 000 5000", "1.2.3"]
    values = phones + cards + dates + left
    got = [r for r in pii.pseudonymize(spark.createDataFrame([(k, f"a {v}, b") for k, v in enumerate(values)], DOCS), "k").orderBy("doc_id").collect()]
    new = dict(zip(values, (r.text[2:-3] for r in got)))
    kinds = dict(zip(values, ((r.pii_phone, r.pii_card, r.pii_date, r.n_pii) for r in got)))
    for v in phones:
        assert kinds[v] == (1, 0, 0, 1) and new[v] != v and re.sub("[0-9]", "0", new[v]) == re.sub("[0-9]", "0", v), v
    for v in cards:
        assert kinds[v] == (0, 1, 0, 1) and luhn(re.sub("[^0-9]", "", new[v])) == 0 and re.sub("[0-9]", "0", new[v]) == re.sub("[0-9]", "0", v), v
    for v in dates:
        assert kinds[v] == (0, 0, 1, 1) and new[v] != v, v
    for v in left:
        assert kinds[v][3] == 0 and new[v] == v, v
    assert pii_day(spark, "+44 20 7946 0958 2024") == new["+44 20 7946 0958"] + " 2024"
    assert new["+15551234567"] == "+1" + re.sub("[^0-9]", "", new["555-123-4567"])
    assert [int(x) for x in new["31/12/1999"].split("/")][1] <= 12 < min(int(new[v].split("/")[1]) for v in ("12/31/1999", "1/31/2000"))
    assert new["1985-3-4"].split("-") == pii_day(spark, "04/03/1985").split("/")[::-1]


def test_pseudonyms_of_valid_values_are_valid_and_distinct(spark):
    n = F.col("id")
    digit = lambda m, w: F.lpad((n * 7919 % m).cast("string"), w, "0")
    rows = spark.range(10_000)
    body = F.concat(F.lit("37"), digit(10**9 + 7, 13))
    iban = F.concat(F.lit("00"), F.lit("WEST"), digit(10**9 + 7, 14))
    values = {
        "social": F.concat_ws("-", F.lpad((n % 665 + 1).cast("string"), 3, "0"), F.lpad((n % 99 + 1).cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0")),
        "phone": F.concat(F.lit("("), (n % 800 + 200).cast("string"), F.lit(") "), (n % 799 + 200).cast("string"), F.lit("-"), F.lpad((n % 10000).cast("string"), 4, "0")),
        "date": F.date_format(F.date_add(F.to_date(F.lit("1950-01-01")), n.cast("int")), "yyyy-MM-dd"),
        "card": F.concat(body, ((10 - pii.luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")),
        "address": F.concat_ws(".", *((F.floor(n * 104_729 / 256**k) % 256).cast("string") for k in (3, 2, 1, 0))),
        "iban": F.concat(F.lit("GB"), F.lpad((98 - pii._checked(F.concat(F.lit("GB"), iban))).cast("string"), 2, "0"), iban.substr(3, 30)),
    }
    for kind, value in values.items():
        made = rows.select(value.alias("v")).withColumn("kind", pii.kind_of(F.col("v"))).withColumn("p", pii.pseudonym(F.col("v"), F.col("kind"), "k"))
        got = made.select("v", "p", (F.col("kind") == kind).alias("was"), (pii.kind_of(F.col("p")) == kind).alias("stays")).toPandas()
        assert got.was.all() and got.stays.all(), kind
        assert got.p.nunique() == got.v.nunique() and (got.p != got.v).mean() > 0.99, kind
        if kind == "phone":
            assert got.p.str.match(r"\([2-9]\d\d\) [2-9]\d\d-").all()


def test_more_formats_and_what_is_none_of_them(spark):
    changed = ("2020-01-02T10:00:00", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "2001:db8::ff00:42:8329", "2001:0DB8:0000:0000:0000:ff00:0042:8329", "1:2:3:4:5:6:7:8")
    left = ("GB83 WEST 1234 5698 7654 32", "std::vector", "a::b", "10:20:30", "XX00 1234", "DE89370400440532013001", "a:b:c", "::", "")
    values = [*changed, *left]
    texts = pii.pseudonymize(spark.createDataFrame([(k, f"see {v}; end") for k, v in enumerate(values)], DOCS), "k").orderBy("doc_id").collect()
    got = {v: r.text[4:-5] for v, r in zip(values, texts)}
    assert all(got[v] != v for v in changed) and all(got[v] == v for v in left)
    assert got["2020-01-02T10:00:00"][10:] == "T10:00:00" and got["2001:db8::ff00:42:8329"] == got["2001:0DB8:0000:0000:0000:ff00:0042:8329"]
    assert re.fullmatch(r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d", got["GB82 WEST 1234 5698 7654 32"]) and re.fullmatch(r"DE\d{20}", got["DE89370400440532013000"])
    assert pii.pseudonymize(spark.createDataFrame([], DOCS), "k").count() == 0
    rows = spark.createDataFrame([(1, "ip 1.2.3.4"), (1, "ip 1.2.3.4"), (2, "x 1.2.3.4 " * 20_000)], DOCS)
    out = [r.text for r in pii.pseudonymize(rows, "k").orderBy("doc_id").collect()]
    assert out[0] == out[1] != "ip 1.2.3.4" and len(set(out[2].split())) == 2


def pii_day(spark, date):
    return pii.pseudonymize(spark.createDataFrame([(1, date)], DOCS), "k").first().text


# --- quality rules and classifier


def test_base_counts_equal_brute_force():
    random.seed(2)
    texts = [t for _, t in ODD] + ["".join(random.choice("ab é\n#|\t") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    got = quality_rules.base_counts(*common.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        w, lines, seen, repeated = words(t), (t or "").split("\n"), set(), 0
        for line in lines:
            if words(line):
                repeated += line in seen
                seen.add(line)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeated, len(hit)), t


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    random.seed(3)
    prose = " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(2, 8))) for _ in range(200))
    noise = " ".join(base64.b85encode(random.randbytes(40)).decode() for _ in range(60))
    rows = [*ODD, (10, prose), (11, "word " * 300), (12, noise)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
    assert (got[10], got[11], got[12], got[1]) == (True, False, False, False)


def test_bands_equal_brute_force(spark):
    random.seed(14)
    word = lambda: "".join(random.choices("etaoinshrdlué", k=random.randint(1, 9)))
    texts = [None, "", "x", *(" ".join(word() for _ in range(random.choice([5, 60, 200, 900]))) for _ in range(60))]
    texts += [" ".join([random.choice(["spam spam", word()]) for _ in range(300)]) for _ in range(30)] + [base64.b85encode(random.randbytes(random.randint(50, 3000))).decode() for _ in range(20)] + ["long text " * 60_000, " ".join(base64.b85encode(random.randbytes(40)).decode() for _ in range(70))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        raw, w = (t or "").encode(), words(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        size = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) / max(1, len(b))
        low, high = next(b[1:] for b in quality_rules.WHOLE_BANDS if len(raw) < b[0])
        chunks = [size(raw[a : a + 1024]) for a in range(0, len(raw), 1024) if len(raw[a : a + 1024]) >= 512]
        within = low <= size(raw) <= high and sum(not 0.28 <= c <= 0.85 for c in chunks) <= 0.25 * len(chunks)
        assert got[k] == (failed, within and not failed), k
    assert len({v for v in got.values()}) >= 3
    assert quality_rules.apply_rules(docs(spark, ODD).limit(0)).count() == 0


def test_long_labelled_texts_train_within_the_bound(spark, monkeypatch):
    rows = [(k, ("good plain words " if k % 2 else "$$$ buy now ") * 3000 + str(k)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert quality_classifier.train(docs(spark, rows), labels) is not None
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 1000)
    assert quality_classifier.train(docs(spark, rows), labels) is None
    assert quality_classifier.score_quality(docs(spark, rows).limit(0), None).count() == 0


def test_scores_keep_rows_and_columns(spark):
    rows = [(k, ("good words of a plain text " if k % 2 else "$$$ buy %%% now &&& ") * (k % 7 + 1) + str(k)) for k in range(100, 200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 200)], "doc_id long, quality int")
    d = docs(spark, [*rows, *ODD])
    model = quality_classifier.train(d, labels)
    got = quality_classifier.score_quality(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    right = sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id and r.doc_id >= 100)
    assert right >= 95
    assert quality_classifier.train(d, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score_quality(d, None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    out = queries.op10_quality_classifier(spark, SF.replace("sf0.001", "sf0.01")).where("held_out").join(spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


# --- packing


def test_best_fit_decreasing_equals_one_by_one():
    random.seed(4)
    for _ in range(150):
        capacity = random.choice([5, 16, 33, 64])
        lengths = [min(capacity, random.choice([1, 2, random.randint(1, capacity)])) for _ in range(random.randint(1, 120))]
        counts = collections.Counter(lengths)
        plan = packing.best_fit_decreasing(counts, capacity)
        length = np.array(sorted(lengths))
        rank = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
        bins = collections.defaultdict(list)
        for s, o, n in zip(*plan.place(length, rank), length):
            bins[int(s)].append((int(o), int(n)))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [k for k, r in enumerate(rooms) if r >= n]
            k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
            if not fit:
                rooms.append(capacity)
            rooms[k] -= n
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == sorted(rooms)


def packing_pieces(spark, rows, path):
    return collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in packing.pack_documents(docs(spark, rows), path).collect())


def test_pieces_are_the_tokenizers(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, (20, "don't I'LL 12a34 ---  ''s"), (21, "<|endoftext|> a <|STARTOFTEXT|>b"), (22, "ΑΣ Σ É"), (23, "Word, word. word!? " * 60)]
    t = tokenizers.Tokenizer.from_file(path)
    got = packing.pack_documents(docs(spark, rows), path, capacity=64).collect()
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = collections.Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], dtype="<u4")
            want[d, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == want
    assert packing.pack_documents(docs(spark, rows).limit(0), path).count() == 0
    clash = packing.pack_documents(docs(spark, rows), path, keep=["doc_id", "length", "score"])
    assert clash.columns == ["doc_id", "score", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and clash.agg(F.sum("length")).first()[0] == sum(k[3] * v for k, v in packing_pieces(spark, rows, path).items())


# --- substring dedup


def test_repeated_passages_equal_brute_force(spark):
    random.seed(6)
    passage = [" ".join(random.choice(["ab", "c,", "dé.", "e", "F"]) for _ in range(25)) for _ in range(3)]
    rows = [(500, None), (501, "")]
    for i in range(80):
        parts = [random.choice(passage) if random.random() < 0.4 else " ".join(random.choice(["ab", "c,", "dé.", "e", "g!"]) + random.choice(["", "\n"]) for _ in range(random.randint(0, 12))) for _ in range(random.randint(0, 4))]
        rows.append((i, random.choice(["", " ", "\n"]) + " ".join(parts)))
    for least, count in ((3, 20), (2, 4)):
        units = {}
        for i, t in rows:
            found, current = [], None
            ws = list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))
            for k, w in enumerate(ws):
                current = current or [w.start(), []]
                current[1].append(w[0].lower())
                if w[0][-1] in ".!?;:," or k == len(ws) - 1 or "\n" in t[w.end() : ws[k + 1].start()]:
                    found.append(current)
                    current = None
            units[i] = found
        places, gone = collections.defaultdict(list), collections.defaultdict(set)
        for i, us in units.items():
            for a in range(len(us)):
                b = next((b for b in range(a + least, len(us) + 1) if sum(len(u[1]) for u in us[a:b]) >= count), None)
                if b:
                    places[tuple(w for u in us[a:b] for w in u[1])].append((i, a, b))
        for p in places.values():
            for i, a, b in sorted(p)[1:]:
                gone[i] |= set(range(a, b))
        got = {r.doc_id: r for r in substring_dedup.remove_repeated(docs(spark, rows), min_sentences=least, min_words=count).collect()}
        for i, t in rows:
            at = [u[0] for u in units[i]] + [len(t or "")]
            want = t if not units[i] else t[: at[0]] + "".join(t[at[k] : at[k + 1]] for k in range(len(units[i])) if k not in gone[i])
            assert (got[i].text, got[i].n_removed) == (want, len(gone[i]))


@pytest.mark.parametrize("ends", [("",), ("", "", "", "", ","), ('."', "", "", "", ""), ("。", "", "", "", "؟", ".)")])
def test_passages_of_51_words_are_caught_at_any_offset(ends):
    random.seed(8)

    def some(n):
        return [f"w{random.randrange(10**6)}" + random.choice(ends) for _ in range(n)]

    for k in range(300):
        passage = some(51)
        a, b = (some(random.choice([0, k % 40, 60])) + passage + some(random.choice([0, 7, 60])) for _ in "ab")
        found = [substring_dedup.sentences(*common.text_bytes(pa.array([" ".join(w)]))) for w in (a, b)]
        runs = [{(int(h), int(low)) for h, low, last in zip(s.high, s.low, s.last) if last >= 0} for s in found]
        assert runs[0] & runs[1]


def test_marks_of_other_scripts_and_before_quotes_end_sentences():
    for mark in ('."', ".)", "!’", "?”", "。", "؟", "।", ",", '.")'):
        s = substring_dedup.sentences(*common.text_bytes(pa.array([f"one two{mark} three four"])))
        assert s.words.tolist() == [2, 2], mark
    assert substring_dedup.sentences(*common.text_bytes(pa.array(["(one) é\" ) three"]))).words.tolist() == [4]


def test_a_passage_without_marks_is_removed(spark):
    random.seed(9)
    some = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    passage = some(60)
    got = {r.doc_id: r for r in substring_dedup.remove_repeated(docs(spark, [(1, f"{some(30)} {passage} {some(9)}"), (2, f"{some(13)} {passage}"), (3, some(90))])).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert 20 <= got[2].n_removed_words <= 60


def test_equal_rows_are_one_document(spark):
    text = "one two three four, five six seven eight, nine ten eleven twelve, " * 2
    rows = docs(spark, [*ODD, (9, text), (9, text), (10, text)])
    got = substring_dedup.remove_repeated(rows)
    assert sorted(r.n_removed > 0 for r in got.where("doc_id = 9").collect()) in ([True, True], [False, False])
    assert got.where("doc_id = 10").first().n_removed > 0


def test_runs_with_many_places_are_spread_and_found(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 3)
    random.seed(13)
    some = lambda n: " ".join(f"w{random.randrange(10**6)}" + random.choice(["", "", "."]) for _ in range(n))
    hot, other = some(60), some(60)
    rows = [(k, f"{some(20)}. {hot if k % 3 else other} {some(15)}") for k in range(60)]
    got = {r.doc_id: r.n_removed_words for r in substring_dedup.remove_repeated(docs(spark, rows)).collect()}
    assert got[0] == got[1] == 0 and all(40 <= got[k] <= 62 for k in range(2, 60) if k not in (0, 1))
    assert substring_dedup.remove_repeated(docs(spark, rows).limit(0)).count() == 0


# --- WARC


def test_archive_round_trip_with_a_dictionary():
    records = [warc.Record(k, f"http://x/{k}%\r\n", f"<p>page {k} of many pages</p>".encode() * 20, 0, "", None) for k in range(300)]
    records = [warc.Record(r.page_id, r.url, r.payload, len(r.payload), warc.sha1_base32(r.payload), None) for r in records]
    data = warc.archive([r.encode() for r in records])
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert [warc.decode(f) for f in warc.frames(data)] == records
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(data[:-3]))


def test_broken_records_say_why():
    good = warc.Record(1, None, b"abc", 3, warc.sha1_base32(b"abc"), None).encode()
    for bad, why in ((good.replace(b"abc", b"abd"), "digest"), (good[:-1], "Content-Length"), (good.replace(b"WARC/1.1", b"WARC/9"), "version"), (good.replace(b"WARC-Date", b"Date"), "missing")):
        with pytest.raises(ValueError, match=why):
            warc.decode(bad)


def test_revisits(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (2, "v", "same"), (None, "u", "same"), (9, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.round_trip(spark, pages).collect()))
    assert got == [(0, "response", 0, 4), (1, "revisit", 2, 4), (2, "response", 0, 4), (2, "response", 0, 4), (3, "revisit", 4, 0), (4, "response", 0, 0), (9, "response", 0, 2)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_broken_archives_are_errors(spark, tmp_path):
    records = [warc.Record(k, None, b"abc", 3, warc.sha1_base32(b"abc"), None).encode() for k in range(3)]
    (tmp_path / "a").write_bytes(warc.archive(records)[:-2])
    (tmp_path / "b").write_bytes(warc.archive([records[0], records[1].replace(b"abc", b"abd"), records[2]]))
    (tmp_path / "c").write_bytes(warc.archive(records[:2]))
    for name, why in (("a", "cut off"), ("b", "digest"), ("c", "2 records instead of 3")):
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}", 3, 10)], "path string, records long, bytes long")
        with pytest.raises(Exception, match=why):
            warc.read_archives(manifest).collect()
        loose = warc.read_archives(manifest, strict=False).collect()
        assert sum(r.error is not None for r in loose) == 1


def test_copies_of_common_payloads_are_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    monkeypatch.setattr(warc, "BATCH_PAYLOADS", 600)
    rows = [(k, f"u{k}", ("", "error page", "three", f"own {k}")[0 if k % 2 else 1 if k % 3 else 2 if k % 4 else 3]) for k in range(200)]
    last = {h: max(k for k, _, x in rows if x == h) for _, _, h in rows}
    got = {r.page_id: (r.record_type, r.refers_to, r.payload.decode() if r.payload is not None else None) for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("response", None, h) if last[h] == k else ("revisit", last[h], None) for k, _, h in rows}


# --- HTML


PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav>menu</nav><div class='ad'>buy</div>%s<footer>f</footer></body></html>"


def test_marked_articles():
    source = PAGE % "<article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four&nbsp; five<!-- x --><aside>side</aside><div class='comments'>c</div><form>f</form></article>"
    lines = html_diff.page_lines(source)
    assert [text for part, _, text in lines if part == html_diff.ARTICLE] == ["A & B", "one two three", "four five"]
    assert [part for part, _, _ in lines].count(html_diff.HIDDEN) == 6
    assert html_diff.main_text(lines, None) == html_diff.main_text(lines, lines) == ["A & B", "one two three", "four five"]
    assert html_diff.page_lines("") == []


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))


def test_lines_of_neighbours_are_deleted(spark):
    rows = [(1, "http://h/a/1", "<div>site</div><div>first</div>"), (2, "http://h/a/2", "<div>site</div><div>second</div>"), (3, "http://other/", "<p>alone"), (4, None, None), (5, "http://h/z", PAGE % "<article><p>site</article>")]
    rows += [(6, "http://m/1", "<!-- <article> --><div>top</div><p>six"), (7, "http://m/2", "<div>top</div><main><p>top</main>"), (8, "http://c/1", "<p>copy"), (8, "http://c/1", "<p>copy"), (None, "http://c/2", "<p>copy")]
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_diff.extract_text(pages_of(spark, rows)).collect())
    want = {(1, "first", 5): 1, (2, "second", 6): 1, (3, "alone", 5): 1, (4, "", 0): 1, (5, "site", 4): 1, (6, "six", 3): 1, (7, "top", 3): 1, (8, "copy", 4): 2, (None, "copy", 4): 1}
    assert got == want
    assert html_diff.extract_text(pages_of(spark, rows).limit(0)).count() == 0
    by_name = spark.createDataFrame([("x", "http://h/1", "<p>a<p>b"), ("y", "http://h/2", "<p>a<p>c")], "page_id string, url string, html string")
    assert {r.page_id: r.text for r in html_diff.extract_text(by_name).collect()} == {"x": "b", "y": "c"}


def brute_extract(rows):
    """All pages in one list, each against its neighbours, aligned by the textbook table."""
    located = []
    for i, u, h in rows:
        rest = (u or "").split("://", 1)
        m = re.match(r"([^/?#]*)([^?#]*)", rest[1]) if len(rest) > 1 else None
        located.append(((m[1].lower(), m[2]) if m else ("", ""), i, u, h or ""))
    located.sort(key=lambda r: (r[0][0].encode(), r[0][1].encode(), (r[1] is not None, r[1] or 0), r[3]))
    lines = [html_diff.page_lines(r[3]) for r in located]
    texts = [[t for p, _, t in x if p] for x in lines]
    out = []
    for k, ((host, path), i, _, _) in enumerate(located):
        best = None
        for j in (k - 1, k + 1):
            if 0 <= j < len(located) and host and located[j][0][0] == host and texts[j] != texts[k]:
                n = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(path, located[j][0][1]))))
                best = max(best or (-1, 0, 0), (n, -j, j))
        marked = any(p == 2 for p, _, _ in lines[k])  # what is left of such a page doesn't depend on its neighbour
        a, b = [x[1] for x in lines[k]], [x[1] for x in lines[best[2]]] if best and not marked else []
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
        out.append((i, marked, len(a) - table[-1][-1], len(texts[k]), [t for p, _, t in lines[k] if p == 2]))
    return out


@pytest.mark.parametrize(("parts", "chunk"), [(1, 256), (4, 2), (211, 5)])
def test_pages_equal_brute_force_however_they_are_dealt_out(spark, monkeypatch, parts, chunk):
    random.seed(12)
    monkeypatch.setattr(html_diff, "CHUNK_PAGES", chunk)
    rows = [(k, f"http://{random.choice(['big', 'big', 'x', 'y'])}.test/{random.choice('ab')}/{random.randrange(40)}", "".join(f"<p>{random.choice('stuvw')}{random.choice(['', k])}" for _ in range(random.randint(0, 6)))) for k in range(120)]
    rows += [(500 + k, f"http://big.test/a/{k}", PAGE % f"<article><p>s<p>{k}</article>") for k in range(20)] + [(7, None, "<p>s"), (None, "http://x.test/a/1", "<p>s<p>t")]
    got = {r.page_id: r.text for r in html_diff.extract_text(pages_of(spark, rows).repartition(parts)).collect()}
    assert len(got) == len(rows) - 1  # page 7 twice
    for i, marked, left, total, article in brute_extract([r for r in rows if r != (7, None, "<p>s")]):
        kept = got[i].split("\n\n") if got[i] else []
        if marked:
            assert kept == article
        elif i != 7:
            assert len(kept) == left, i


def test_whole_table_of_pages_equals_one_page_after_another(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in queries.op9_html_extraction(spark, SF).collect()}
    want = {i: "\n\n".join(article) for i, marked, _, _, article in brute_extract(rows) if marked}
    assert {i: got[i] for i in want} == want and len(got) == len(rows)


def test_shared_lines_are_a_longest_common_subsequence():
    random.seed(7)
    for _ in range(500):
        a, b = (random.choices("abcd", k=random.randint(0, 14)) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        places = html_diff.shared(a, b)
        rest = iter(b)
        assert len(places) == table[-1][-1] and all(a[k] in rest for k in sorted(places))
    one, two = ([f"{c}{k}" for k in range(n)] for c, n in (("a", 1500), ("b", 1499)))
    whole = [*one, "M", *two, "x"]
    places = html_diff.shared(whole, ["M", *one, *two, "y"])
    assert [x for k, x in enumerate(whole) if k not in places] == ["M", "x"]


def test_long_and_broken_pages_take_linear_time():
    began = time.monotonic()
    for source in ("<b>" * 50_000 + "x" + "</i>" * 50_000, "<p><b>" * 30_000, "<div class='" * 20_000, "<p>line</p>" * 50_000, "<" * 100_000):
        lines = html_diff.page_lines(source)
        html_diff.main_text(lines, lines[1:])
    assert time.monotonic() - began < 60


# --- pipeline


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    random.seed(15)
    text = lambda n: " ".join(f"w{random.randrange(3000)}" for _ in range(n))
    item = text(15)
    base = [text(40) for _ in range(12)]
    rows = [*ODD, *enumerate(base, 100), *((200 + k, b + " tail") for k, b in enumerate(base[:5])), (300, f"{text(9)} {item} {text(9)}"), (301, "mail me@mail.example.com or call (974) 555-3436"), (None, base[0]), (302, text(5000)), (302, text(5))]
    d = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long")).withColumn("n_words", F.lit("clash"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(100, 112)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    scored = corpus_pipeline.quality(spark, d, str(tmp_path))
    assert scored.columns == d.columns and scored.count() <= len(rows)

    once = common.written(corpus_pipeline.near_duplicates(spark, d, str(tmp_path)), "test")
    kept = sorted((str(r.doc_id), str(r.text)) for r in once.collect())
    gone = {(str(200 + k), b + " tail") for k, b in enumerate(base[:5])} | {("None", base[0])}
    assert kept == sorted((str(i), str(t)) for i, t in rows if (str(i), str(t)) not in gone)

    clean = corpus_pipeline.decontamination(spark, once, str(tmp_path))
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(i for i, _ in kept if i != "300")
    private = {(str(r.doc_id), r.n_chars): r.text for r in corpus_pipeline.personal_data(spark, clean, str(tmp_path)).collect()}
    assert all(t is None or len(t) == n for (_, n), t in private.items()) and not any("555-3436" in (t or "") or "mail.example" in (t or "") for t in private.values())

    packed = corpus_pipeline.packed(spark, clean, str(tmp_path)).collect()
    room = collections.defaultdict(list)
    for r in packed:
        room[r.sequence_id].append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(room) <= -(-sum(r.length for r in packed) // 2048) + 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    d = common.table(spark, SF, "documents").withColumn("extra", F.lit(1))
    kept = corpus_pipeline.quality(spark, d, SF)
    assert kept.columns == d.columns
    once = common.written(corpus_pipeline.near_duplicates(spark, kept, SF), "test")
    assert once.columns == d.columns
    components = {r.doc_id: r.component_id for r in ngram_join.find_groups(kept).collect()}
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(set(components.values()))
    clean = corpus_pipeline.decontamination(spark, once, SF)
    hits = decontaminate.find_contamination(once, common.table(spark, SF, "benchmark")).where("n_hit = 0").count()
    assert (clean.count(), clean.columns) == (hits, d.columns)
    private = corpus_pipeline.personal_data(spark, clean, SF)
    assert private.columns == d.columns and private.count() == clean.count()
    assert private.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.packed(spark, private, SF)
    assert packed.select("doc_id").distinct().count() == private.count()


def test_marks_at_word_ends_in_runs_of_any_length():
    import re

    from plumbline.llm import packing

    texts = ["ab..", "c!" + "." * 40 + " d-", "...", "", "e.f..", "é!", "g" + "-" * 16, "h" + "-" * 17]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    start, end, _ = packing.word_spans(data, offsets, packing.SPACE_BYTES)
    for some in (slice(None), slice(0, 1)):  # with and without a long run
        a, b = packing._split_marks(data, start[some], end[some])
        got = [data[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)]
        words = [w for t in texts for w in t.split()][some]
        met = [(w, re.fullmatch(r"(.*[a-z0-9])([!.-]+)", w)) for w in words]
        assert got == [p for w, m in met for p in (m.groups() if m else (w,))]
