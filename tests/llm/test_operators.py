"""Each operator against plain Python, on odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import boosting, byte_cnn, chat, media, mixing, near_dedup, packing, pii, quality_rules, token_counts, url_filter
from plumbline.llm.common import fresh_path
from plumbline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30000))
BASE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green trees near our house today"
ODD = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " again", "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t", "en", None, 3),
    (7, LONG, "en", "c", 9), (8, "two words", "fr", "b", 9), (9, "TWO words", "fr", "b", 9), (8, "two words", "fr", "b", 9), (10, "é <|endoftext|> ß\x1cx 日本 it's I'LL", "de", "c", 5),
    (11, "a#b$ c|d\nsame line\nsame line\n", "en", "b", 5), (12, "w " * 50, "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    clash = {c: F.lit("other") for c in ("score", "predicted", "size", "h", "bucket", "ids", "n", "id", "key", "position", "digest", "label", "words", "s", "b", "at", "__found", "__New", "kept", "source_size", "target")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_sql(spark):
    import duckdb
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        show = lambda df: sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
        assert show(got) == show(want), name


def test_token_counts(spark, docs, odd, none):
    got = {tuple(r) for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    toxic = {r.doc_id for r in table(spark, "labels").where("toxic = 1").collect()}
    t = packing.Tokens(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    n, total = Counter(), Counter()
    for r in docs.collect():
        if r.doc_id not in toxic:
            text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            for v, k in (("words/1", len(WORD.findall(text))), ("word_bpe_49k/1", len(t.encode(text, add_special_tokens=False).ids))):
                n[r.source, r.lang, v] += 1
                total[r.source, r.lang, v] += k
    assert got == {(*k, n[k], total[k]) for k in n}
    roll = token_counts.TokenRollup(spark, fresh_path(spark, "odd"))
    assert roll.totals().count() == 0
    assert roll.commit("none", token_counts.changes(token_counts.count_tokens(none)))
    assert roll.commit("all", token_counts.changes(token_counts.count_tokens(odd, ["words/1"]))) and not roll.commit("all", token_counts.changes(token_counts.count_tokens(odd)))
    want = Counter({(r[3], r[2]): 0 for r in ODD})
    for r in {r[0]: r for r in ODD}.values():
        want[r[3], r[2]] += len(WORD.findall(r[1] or ""))
    assert {(r.source, r.lang): r.n_tokens for r in roll.totals().collect()} == dict(want)
    assert roll.commit("gone", token_counts.changes(roll.in_force(), deleted=True)) and roll.totals().count() == 0
    assert roll.commit("gone-2", token_counts.changes(roll.in_force(), deleted=True)) and roll.totals().count() == 0


def test_token_rollup_reads_what_a_batch_needs(spark, tmp_path, monkeypatch):
    """Null ids, a crash between stage and commit, buckets, and compaction."""
    row = lambda i, n, source="s": (i, source, "en", "v", n, False, 0)
    batch = lambda *rows: spark.createDataFrame(rows, token_counts.CHANGE)
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r", 4)
    total = lambda: {(r.source, r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert roll.commit("a", batch(*(row(i, 10) for i in range(40)), row(None, 3), row(None, 4, None), row(None, 5))) and total() == {("s", 42, 408), (None, 1, 4)}

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_counts.TokenRollup, "publish", lost)
        with pytest.raises(RuntimeError):
            roll.commit("b", batch(row(1, 99)))
    assert total() == {("s", 42, 408), (None, 1, 4)}
    assert roll.commit("b", batch(row(1, 99), (None, "s", "en", "v", 5, True, 0), (2, "s", "en", "v", 0, True, 0))) and not roll.commit("b", batch(row(1, 99)))
    assert total() == {("s", 40, 482), (None, 1, 4)}
    files = roll.in_force(batch(row(7, 0)).select("doc_id", "tokenizer")).inputFiles()
    everything = roll.in_force().inputFiles()
    assert files and [r.n_tokens for r in roll.in_force(batch(row(7, 0)).select("doc_id", "tokenizer")).collect()] == [10] and len(everything) > 4
    again = token_counts.TokenRollup(spark, f"file://{tmp_path}/r", 99)
    assert again.buckets == 4
    again.compact(remove=True)
    assert total() == {("s", 40, 482), (None, 1, 4)} and not roll.commit("a", batch(row(1, 5))) and roll.commit("c", batch(row(1, 9), row(2, 1)))
    assert total() == {("s", 41, 393), (None, 1, 4)}
    with pytest.raises(ValueError):
        roll.commit("compact", batch())
    assert roll.buckets == 99
    plan = roll.in_force(batch(row(7, 0), row(9, 0)).select("doc_id", "tokenizer"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,7)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    assert roll.in_force(batch().select("doc_id", "tokenizer")).count() == 0


def test_token_rollup_of_two_writers(spark, tmp_path, monkeypatch):
    """A batch that another writer overtakes is worked out anew behind it, and the same one is counted once; a compaction gives way."""
    batch = lambda *rows: spark.createDataFrame([(i, "s", "en", "v", n, False, 0) for i, n in rows], token_counts.CHANGE)
    one, two = (token_counts.TokenRollup(spark, f"file://{tmp_path}/r", k) for k in (2, 3))
    total = lambda: {(r.n_docs, r.n_tokens) for r in one.totals().collect()}
    assert one.buckets is None and one.commit("a", batch((1, 10), (2, 10))) and two.buckets == 2
    real = token_counts.TokenRollup.publish

    def overtaken_by(name, *rows):
        def publish(self, *args):
            monkeypatch.setattr(token_counts.TokenRollup, "publish", real)
            assert two.commit(name, batch(*rows))
            return real(self, *args)

        monkeypatch.setattr(token_counts.TokenRollup, "publish", publish)

    overtaken_by("b", (1, 3), (3, 5))
    assert one.commit("c", batch((1, 7), (2, 1))) and total() == {(3, 13)} and one.batches() == ["a", "b", "c"]
    overtaken_by("d", (4, 1))
    assert not one.commit("d", batch((4, 1))) and total() == {(4, 14)}
    overtaken_by("e", (4, 2))
    with pytest.raises(token_counts.PlaceTaken):
        one.compact(remove=True)
    assert total() == {(4, 15)}
    monkeypatch.setattr(token_counts, "BUCKET_ROWS", 2)
    one.compact(remove=True)
    assert one.buckets == 4 and total() == {(4, 15)}  # of eight rows, two a bucket and two.commit("f", batch((4, 1), (5, 1))) and total() == {(5, 15)}
    assert not two.commit("a", batch((1, 1)))


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pii(spark, odd, none):
    said = "a@b.example.com 4539578763621486 4539 5787 6362 1486 4539578763621487 97.51.17.173 300.1.1.1 +1 (017) 555-7713 2021-02-28 2021-02-30 31.12.1999 123-45-6789 666-12-3456 GB82WEST12345698765432 " + "ab12" * 10
    (row,) = pii.pseudonymise(spark.createDataFrame([(said,)], "text string"), "k", count="n").collect()
    old, new = said.split(" "), row.text.split(" ")
    assert len(old) == len(new) and [len(x) for x in old[:5]] == [len(x) for x in new[:5]]
    same = {o for o, n in zip(old, new) if o == n}
    assert same == {"4539578763621487", "300.1.1.1", "2021-02-30", "666-12-3456", "+1"}
    assert luhn(new[1]) and new[1] == "".join(new[2:6]) and all(0 <= int(p) < 256 for p in new[7].split("."))
    assert re.fullmatch(r"\(\d{3}\)", new[10]) and re.fullmatch(r"\d{4}-\d\d-\d\d", new[12]) and re.fullmatch(r"[0-9a-f]{40}", new[-1])
    got = {r.doc_id: r.text for r in pii.pseudonymise(odd, "k").collect()}
    assert all(got[r[0]] == r[1] for r in ODD) and pii.pseudonymise(none, "k").count() == 0
    kept = pii.pseudonymise(odd, "k").drop("text")
    assert kept.columns == [c for c in odd.columns if c != "text"] and kept.exceptAll(odd.drop("text")).isEmpty()
    # a permutation: different numbers never share a pseudonym, and the key matters
    many = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 90 + 1, F.col("id") + 1).alias("text"))
    one = {r.text for r in pii.pseudonymise(many, "k").collect()}
    assert len(one) == 3000 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in one)
    assert one != {r.text for r in pii.pseudonymise(many, "k2").collect()}


class PlainFeistel:
    """The pseudonyms again, in plain Python over strings and integers."""

    def __init__(self, key):
        self.key = key

    def hash(self, bits, *parts):
        return hashlib.new(f"sha{bits}", "\0".join((self.key, *map(str, parts))).encode()).hexdigest()

    def permuted(self, s, kind, letters=26):
        half = [s[: len(s) // 2], s[len(s) // 2 :]]
        for r in range(8):
            moved, by = [], self.hash(512, kind, r, len(s), half[1 - r % 2])
            for i, c in enumerate(half[r % 2]):
                n = int(by[2 * (i % 64) : 2 * (i % 64) + 2], 16)
                first, size = next(((f, k) for f, k, known in ((48, 10, "0123456789"), (97, letters, "abcdefghijklmnopqrstuvwxyz"), (65, letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if c in known), (None, 0))
                moved.append(c if first is None else chr(first + (ord(c) - first + n) % size))
            half[r % 2] = "".join(moved)
        return "".join(half)

    def grid(self, n, size, kind):
        at = [n // size[1], n % size[1]]
        for r in range(8):
            at[r % 2] = (at[r % 2] + int(self.hash(256, kind, r, at[1 - r % 2])[:12], 16)) % size[r % 2]
        return at[0] * size[1] + at[1]

    def digits_into(self, form, new):
        left = iter(new)
        return "".join(next(left) if c in "0123456789" else c for c in form)

    def __call__(self, m):
        d = re.sub("[^0-9]", "", m)
        if "@" in m:
            low = m.lower()
            cut = low.rindex(".")
            new = self.permuted(low[:cut], "mail") + low[cut:]
            return "".join(n.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else n for c, n in zip(m, new, strict=True))
        if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
            parts = [int(p) for p in m.split(".")]
            n = self.grid(int.from_bytes(bytes(parts), "big"), (65536, 65536), "ip") if max(parts) < 256 else None
            return m if n is None else ".".join(map(str, n.to_bytes(4, "big")))
        if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}", m):
            return self.day(m)
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            a, g, n = (int(p) for p in m.split("-"))
            if not 0 < a < 900 or a == 666 or not g or not n:
                return m
            k = self.grid((a - 1 - (a > 666)) * 989901 + (g - 1) * 9999 + n - 1, (898, 989901), "ssn")
            a, rest = k // 989901 + 1, k % 989901
            return f"{a + (a >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
        if re.fullmatch(r"[+(].*|\d{3}[.-]\d{3}[.-]\d{4}", m):
            if not 7 <= len(d) <= 15:
                return m
            code = (re.match(r"\+\d{1,3}(?=[ .(-])", m) or [""])[0]
            rest = m[len(code) :]
            return code + self.digits_into(rest, self.permuted(re.sub("[^0-9]", "", rest), "phone"))
        if re.fullmatch(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", m):
            value = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
            words = m.split(" ")
            ends = [" ".join(words[:i]) for i in range(len(words), 0, -1)]
            first = next((e for e in ends if len(f := e.replace(" ", "")) >= 12 and value(f[4:] + f[:4]) == 1), None)
            if first is None:
                return m
            m, after = first, m[len(first) :]
            flat = m.replace(" ", "")
            body = self.permuted(flat[4:], "iban")
            left = iter(f"{flat[:2]}{98 - value(body + flat[:2] + '00'):02d}{body}")
            return "".join(c if c == " " else next(left) for c in m) + after
        if re.fullmatch(r"[\d -]+", m):
            if not luhn(d) or len(set(d)) == 1:
                return m
            body = self.permuted(d[:-1], "card")
            return self.digits_into(m, body + next(c for c in "0123456789" if luhn(body + c)))
        new = self.permuted(m.lower(), "hex", 6)
        return new if m == m.lower() else new.upper()

    def day(self, m):
        from datetime import date, timedelta

        forms = ["%Y-%m-%d"] if "-" in m else ["%d.%m.%Y"] if "." in m else ["%m/%d/%Y", "%d/%m/%Y"]
        for i, form in enumerate(forms):
            where = {c: form.index(c) for c in "Ymd"}
            at = [m[0:4], m[5:7], m[8:10]] if "-" in m else [m[6:10], *((m[3:5], m[0:2]) if where["d"] < where["m"] else (m[0:2], m[3:5]))]
            try:
                n = (date(*map(int, at)) - date(1900, 1, 1)).days
            except ValueError:
                continue
            if not 0 <= n < 17 * 4297:
                return m
            n = self.grid(n, (17, 4297), "day")
            while i and (date(1900, 1, 1) + timedelta(n)).day <= 12:
                n = self.grid(n, (17, 4297), "day")
            return (date(1900, 1, 1) + timedelta(n)).strftime(form)
        return m


def test_pii_equals_a_plain_feistel(spark, docs):
    import regex

    found = regex.compile(pii.FOUND.replace("(?<gap>", "(?P<gap>").replace("(?<sep>", "(?P<sep>").replace(r"\k<gap>", "(?P=gap)").replace(r"\k<sep>", "(?P=sep)"), regex.ASCII)
    made = ["31/12/2020 12/31/2020 31.12.2020 2020-12-31 29/02/2000 31/02/2000 05/06/1999", "x@y.Example.ORG A@B.DE, x.y+z@w.org.", "+49 89 12 34 56 78 (212) 555-1234 212-555-1234 +14155550123", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 GB82WEST12345698765433", "4539 5787 6362 1486 378282246310005 3782 822463 10005", "AB12" * 9 + " 8.8.8.8 255.255.255.255 256.1.1.1 899-01-0001 900-01-0001 665-99-9999 667-01-0001"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(made)], "doc_id long, text string"))
    plain, hits = PlainFeistel("k"), 0
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.pseudonymise(df, "k", count="n").collect():
        old, want, at, n = texts[r.doc_id], [], 0, 0
        for m in found.finditer(old):
            new = plain(m[0])
            want += [old[at : m.start()], new]
            at, n = m.end(), n + (new != m[0])
        assert (r.text, r.n) == ("".join(want) + old[at:], n), r.doc_id
        hits += n
    assert hits > 40


def numbers_in(text):
    """Valid account and card numbers that start anywhere in a text, found without the operator's patterns: (kind, number)."""
    sizes, found = {c: n for n, names in IBANS.items() for c in names.split()}, set()
    for i in range(len(text)):
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            continue
        flat = ""
        for j in range(i, min(len(text), i + 60)):
            if text[j] in " -" and flat and text[j - 1] not in " -":
                continue
            if not (text[j].isascii() and text[j].isalnum()):
                break
            flat += text[j]
            if j + 1 < len(text) and (text[j + 1].isalnum() or text[j + 1] == "_"):
                continue
            if "-" not in text[i:j] and re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", flat) and len(flat) == sizes.get(flat[:2]) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                found.add(("iban", flat))
            if re.fullmatch("[0-9]{13,19}", flat) and len(set(flat)) > 1 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(flat[::-1])) % 10 == 0:
                found.add(("card", flat))
    return found


#: Countries by the length of their account numbers, for the finder.
IBANS = {15: "NO", 16: "BE", 18: "DK FI NL", 20: "AT EE LT", 21: "CH HR LV", 22: "DE GB IE", 24: "CZ ES SE", 27: "FR GR IT", 28: "HU PL", 31: "MT"}


def test_pii_leaves_no_valid_number(spark):
    """Account numbers before words in capitals, and whatever else may follow them."""
    r, texts, planted = np.random.default_rng(3), [], []
    check = lambda c, body: f"{98 - int(''.join(str(int(x, 36)) for x in body + c + '00')) % 97:02d}"
    for n, names in IBANS.items():
        for c in names.split():
            body = "".join(r.choice(list("0123456789"), n - 4))
            flat = c + check(c, body) + body
            for form in (flat, " ".join(flat[i : i + 4] for i in range(0, n, 4))):
                for after in (" EUR 500", " WAS", " PAID ON TIME", " and", ".", " 4539 5787 6362 1486", " A1B2 C3", " 2024", "\n", " X"):
                    texts.append(f"{'TO ' * (len(texts) % 2)}{form}{after}")
                    planted.append(flat)
    texts += ["ES9121000418450200051332 EUR 500", "SE4550000000058398257466 WAS", "XX" + check("XX", "ABCD12345678") + "ABCD12345678 TO PAY NOW"]
    planted += ["ES9121000418450200051332", "SE4550000000058398257466", "XX" + check("XX", "ABCD12345678") + "ABCD12345678"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "k").collect()
    for x in rows:
        old, new = texts[x.i], x.text
        assert planted[x.i] not in new.replace(" ", "") and not numbers_in(old) & numbers_in(new), (old, new)
        assert re.sub("[0-9A-Z]", "x", old) == re.sub("[0-9A-Z]", "x", new)
        if not re.search("4539|A1B2", old):
            assert old.rpartition(planted[x.i][-1])[2] == new[len(old) - len(old.rpartition(planted[x.i][-1])[2]) :], (old, new)
    assert {k for t in texts for k, _ in numbers_in(t)} == {"iban", "card"}
    (a, b) = pii.pseudonymise(spark.createDataFrame([("A.b@Ex.com",), ("a.b@ex.com",)], "text string"), "k").collect()
    assert a.text.lower() == b.text and a.text != b.text and [c.isupper() for c in a.text] == [c.isupper() for c in "A.b@Ex.com"]


def test_pii_days_stay_apart(spark):
    from datetime import date, timedelta

    days = [(date(1999, 1, 1) + timedelta(k)).strftime(f) for k in range(1500) for f in ("%d/%m/%Y", "%m/%d/%Y")]
    rows = {*days}
    got = pii.pseudonymise(spark.createDataFrame([(d,) for d in rows], "text string").withColumn("old", F.col("text")), "k").collect()
    assert len({r.text for r in got}) == len(rows) and all(r.text != r.old for r in got)


def test_pii_alone_in_a_text(spark):
    """No other digits help the candidate to be tried, and groups of a number don't stay behind."""
    said = ["8.8.8.8", "at 1.1.1.1, said", "a1b2c3d4" * 4, "key " + "A1B2C3D4" * 4 + "\n", "+33 1 23 45 67 89", "+49 89 12 34 56 78", "+49.89.12.34.56.78.90", "+1 202 555 0143 2021 1999"]
    rows = pii.pseudonymise(spark.createDataFrame([*enumerate(said), (99, "8.8.8.8 and 42")], "i int, text string"), "k", count="n").collect()
    got = {r.i: r.text for r in rows}
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", s)))
    assert all(r.n == 1 for r in rows) and got[99] == got[0] + " and 42" and got[7].endswith(" 1999")
    assert all(shape(got[i]) == shape(said[i]) and not {*said[i].split()[-2:]} & {*got[i].split()} for i in (4, 5, 6))
    plain = ["1. 2", "v1.2", "x 7", "abcdef" * 9, "1.2.3", None, ""]
    assert [(r.text, r.n) for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in plain], "text string").coalesce(1), "k", count="n").collect()] == [(x, 0) for x in plain]


def test_pii_query_leaves_clean_texts(spark, docs):
    got = {r.doc_id: (r.text, r.n_replaced) for r in QUERIES["op2_pii"](spark, SF).collect()}
    valid = [re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), re.compile(r"\+1 \(\d{3}\) 555-\d{4}"), re.compile(r"(?<!\w)[0-9a-f]{40}(?!\w)"), re.compile(r"(?<![\w.])\d+\.\d+\.\d+\.\d+(?!\w)")]
    for r in docs.collect():
        found = [m for p in valid for m in p.findall(r.text)] + [m for m in re.findall(r"(?<!\w)\d{16}(?!\w)", r.text) if luhn(m)]
        assert all(m not in got[r.doc_id][0] for m in found if "@" not in m or m[-1] != ".")
        assert found or got[r.doc_id] == (r.text, 0)


def test_chat(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "", None, "a\nb", "日本<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(texts)] + [(2, None, None, "x"), (2, 0, "r%0A\n<|", "y"), (2, 0, "r%0A\n<|", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.to_variant_object(F.struct("role", "text"))).withColumn("turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(chat.canonical_turns(df.drop("turns"), "record"), "conv_id", "turn").withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [(r[2], r[3] or "") for r in rows[:9]]
    assert [(t.role, t.text) for t in got[2].read] == [("", "x"), ("r%0A\n<|", "y"), ("r%0A\n<|", "y")]
    back = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    assert [back(got[1].formatted[s.start : s.start + s.length]) for s in got[1].loss_spans] == [x or "" for x in texts[1::2]]
    assert got[1].loss == [bool(i % 2) for i in range(9)] and got[1].formatted.count("<|im_end|>") == 9


def test_chat_layouts(spark):
    said = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}], "id": 3}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "response": "a"}', '{"prompt": "q", "response": "a", "system": "s"}', '{"instruction": "i", "input": "x", "output": "o"}', '{"instruction": "i", "output": "o"}', '{"unknown": 1}',
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").withColumn("v", F.parse_json("s"))
    got = {r.i: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df, "v").collect()}
    assert got == {
        0: ("messages", [("user", "q"), ("assistant", "")]), 1: ("shares", [("user", "q"), ("assistant", "a")]), 2: ("prompt_response", [("user", "q"), ("assistant", "a")]),
        3: ("prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]), 4: ("instruction", [("user", "i\nx"), ("assistant", "o")]), 5: ("instruction", [("user", "i"), ("assistant", "o")]), 6: (None, None),
    }
    assert chat.format_conversations(chat.canonical_turns(df.limit(0), "v"), "i", "i").count() == 0


def test_chat_ties_follow_the_raw_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|b"), (1, 0, "user", "<a"), (1, 0, "a", "z")], "conv_id long, turn long, role string, text string").withColumn("record", F.to_variant_object(F.struct("role", "text")))
    (r,) = chat.format_conversations(chat.canonical_turns(df, "record"), "conv_id", "turn", ("user",)).select(chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    assert [x.text for x in r.t] == ["z", "<a", "<|b"] and r.m == "<a<|b"


def test_chat_odd_records(spark):
    """Optional fields of single turns, empty lists, user columns, and a count of the records that no mapping reads."""
    said = ['{"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}]}', '{"messages": []}', '{"prompt": "p", "completion": "c", "id": 3}', '{"text": "t"}', '{"text": "u"}', "7"]
    df = spark.createDataFrame([(i, s, "own", "mine") for i, s in enumerate(said)], "i int, s string, layout string, __print string").withColumn("v", F.parse_json("s"))
    got = chat.canonical_turns(df, "v", layout="form").orderBy("i").collect()
    assert [r.form for r in got] == ["messages", "messages", "prompt_completion", None, None, None] and {r["__print"] for r in got} == {"mine"} and {r.layout for r in got} == {"own"}
    assert [r.turns and [tuple(t) for t in r.turns] for r in got] == [[("user", "q"), ("assistant", "a")], [], [("user", "p"), ("assistant", "c")], None, None, None]
    counts = {(r.layout, r.structure): r.n for r in chat.layout_counts(df, "v").collect()}
    assert sum(n for (k, _), n in counts.items() if k is None) == 3 and sum(counts.values()) == 6


def naive_score(net, text):
    """The network's forward pass, byte by byte."""
    b, out = (text or "").encode(), []
    for at in range(0, max(1, len(b) - byte_cnn.CHUNK + byte_cnn.STEP), byte_cnn.STEP):
        chunk = b[at : at + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
        out.append([max(0.0, max(sum(float(net.taps[j][chunk[i + j]][f]) for j in range(byte_cnn.WIDTH)) for i in range(byte_cnn.CHUNK - byte_cnn.WIDTH + 1)) + float(net.bias[f])) for f in range(byte_cnn.FILTERS)])
    x = [g(c) for g in (lambda c: sum(c) / len(c), max, min) for c in zip(*out, strict=True)]
    h = [max(0.0, sum(a * float(w) for a, w in zip(x, net.w1[:, k], strict=True)) + float(net.b1[k])) for k in range(byte_cnn.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * float(w) for a, w in zip(h, net.w2, strict=True)) + float(net.b2[0]))))


def test_classifier_equals_a_plain_forward_pass(spark, docs):
    net = byte_cnn.fit_network(docs, table(spark, "labels"))
    rows = byte_cnn.classify(docs.where("length(text) < 1500"), net).collect()
    assert len(rows) > 50 and all(abs(r.score - naive_score(net, r.text)) < 1e-4 for r in rows[:40])
    assert abs(net.score([None])[0] - naive_score(net, "")) < 1e-4


def test_classifier(spark, odd, none):
    rows = QUERIES["op4_quality_classifier"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    net = byte_cnn.train([byte_cnn.drawn(t)[1] for t in ["good text here " * 5] * 20 + ["### $$$ %%% " * 5] * 20], np.array([1.0] * 20 + [0.0] * 20), 4)
    assert net.score(["good text here " * 9])[0] > 0.5 > net.score(["### $$$ %%% " * 9])[0]
    with pytest.raises(ValueError):
        byte_cnn.classify(odd, net)
    got = byte_cnn.classify(odd.drop("score", "predicted"), net)
    scores = defaultdict(set)
    for r in got.collect():
        scores[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[1] == scores[2] and scores[4] == scores[5]
    assert byte_cnn.classify(none, net).count() == 0 and byte_cnn.fit_network(none, table(spark, "labels")).score(["x"])[0] == 0.5
    # every byte is covered, and a chunk's place doesn't matter to coverage
    chunks, starts = byte_cnn.cut(["x" * n for n in (0, 1, 256, 257, 1000)])
    assert list(np.diff(np.append(starts, len(chunks)))) == [1, 1, 1, 2, 5]


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9 and np.mean([g >= 0.3 for g in good]) > 0.97


def check_pieces(rows, texts):
    t = packing.Tokens(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for n in packing.lengths(len(ids)):
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), 0] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length == 1 << (r.sequence_id % 16) for r in rows)


def test_packing(spark, docs, odd, none, tmp_path):
    check_pieces(QUERIES["op5_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_pieces(packing.digests(packing.pack(odd)).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(none).count() == 0
    rows = QUERIES["op5_packing"](spark, SF).withColumn("part", F.spark_partition_id()).collect()
    assert all(r.length == 1 << r.bucket for r in rows) and all(a.part != b.part or (a.bucket, a.sequence_id) < (b.bucket, b.sequence_id) for a, b in zip(rows, rows[1:], strict=False))
    packing.write_buckets(packing.pack(odd), f"file://{tmp_path}/x")
    assert spark.read.parquet(f"file://{tmp_path}/x").where("length <> pow(2, bucket)").count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, most=100)


def brute_groups(rows, k, threshold):
    sets = []
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_pieces_of_long_texts(monkeypatch):
    import pyarrow as pa
    from plumbline.llm.common import slices

    monkeypatch.setattr(packing, "PIECE", 40)
    texts = [None, "", " ", BASE * 3, "x" * 500, "é " + "日本 " * 60 + "<|endoftext|>", "don't\n" * 50, "a  b" * 40, "ab1c2²d'4s" * 30, "日本1" * 60, "a1<|endoftext|>1" * 20, "é5'ſ6" * 30]
    t = packing.Tokens(packing.public_tokenizers.path("word_bpe_49k.json"))
    assert all("".join(packing.pieces(x or "")) == (x or "") for x in texts) and list(t.encode([])) == []
    assert [*t.encode(texts)] == [np.array(t.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "", "b" * 9, "c", "d", "e"]})
    assert [b.num_rows for b in slices(batch, "text", 3, 4)] == [3, 1, 3] and [*slices(batch.slice(7), "text")] == []


def test_samples_count_a_repeated_id_once(spark):
    rows = [(1, "good words here " * 9), (1, "other words there " * 9), (2, "## $$ " * 9), (3, None), (None, "x")]
    docs, labels = spark.createDataFrame(rows * 2, "doc_id long, text string"), spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    once = spark.createDataFrame([r for r in rows if r[0] == 2 or r[1] == min((x for i, x in rows if i == 1), key=lambda x: byte_cnn.drawn(x)[0])], "doc_id long, text string")
    a, b = (byte_cnn.fit_network(d, labels).score(["good words", None]) for d in (docs, once))
    assert np.array_equal(a, b) and quality_rules.fit_rules(docs, labels).score(np.zeros((1, len(quality_rules.FEATURES)))).shape == (1,)


def test_near_dedup(spark, docs, odd, none):
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    rows = QUERIES["op6_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)
    want = brute_groups([(r[0], r[1]) for r in ODD], 5, 80)
    rows = near_dedup.groups(odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(rows) == len(ODD) + 1 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dedup.groups(none).count() == 0
    left = near_dedup.dedup(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_dedup_chain(spark):
    """A group in which most pairs are not linked, but a chain links all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(16)] + [(100 + i, " ".join(words[:150] + [f"own{i}_{j}" for j in range(40)])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 85).items()}


def test_near_dedup_of_ids_with_several_texts(spark):
    """Two classes may have one smallest id; whichever text of it comes first, no link of the others is lost."""
    text = lambda name, cut=0: " ".join(f"{name}{i}" for i in range(200 - cut))
    rows = [(5, text("a")), (5, text("b")), (7, text("b")), (9, text("b", 4)), (12, text("a", 4))]
    rows += [(20, text("c")), (21, text("c")), (21, text("d")), (22, text("d", 3)), (23, text("e")), (2**63 - 1, text("f")), (-4, text("f", 2))]
    rows += [(30, text(f"g{k}")) for k in range(3)] + [(31 + k, text(f"g{k}", 5)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_groups(rows, 5, 80).items()}
    assert want[9] == want[12] == 5 and want[22] == 20 and want[33] == 30
    assert [(r.doc_id, r.component_id) for r in near_dedup.groups(df).orderBy("doc_id").collect()] == sorted((i, want[i]) for i, _ in rows)
    kept = {(r.doc_id, r.text) for n in (1, 5) for r in near_dedup.dedup(df.repartition(n)).collect()}
    assert kept == {(i, min(t for j, t in rows if j == i)) for i, c in want.items() if i == c}


def test_near_dedup_of_many_that_are_not_linked(spark, monkeypatch):
    """More similar neighbours than leave a block, most of them no links: the full sets decide in regions."""
    monkeypatch.setattr(near_dedup, "NEAREST", 2)
    rows = [(i, " ".join([f"w{j}" for j in range(220)] + [f"own{i}_{j}" for j in range(24)])) for i in range(40)]
    rows += [(100 + i, t + f" and {i}") for i, t in rows[::9]]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    want = {i: c for i, (_, c) in brute_groups(rows, 3, 85).items()}
    assert got == want and len(set(want.values())) > 30
    assert {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()} == {i: c for i, (_, c) in brute_groups(rows, 3, 60).items()}
    with pytest.raises(ValueError):
        near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 40)


@pytest.mark.parametrize("threshold", [50, 60, 80, 85, 90, 97])
def test_bands_miss_few(threshold):
    n, rows = near_dedup.banding(threshold)
    assert n * rows <= near_dedup.BINS and (1 - (threshold / 100) ** rows) ** n <= near_dedup.MISSED


def test_sketch():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 40, 5000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.union1d(a[: len(a) * 9 // 10], r.integers(0, 2**63, max(n // 10, 1), dtype=np.uint64))
        s = near_dedup.sketch([a, b, a[:0]])
        assert (s[:2] != near_dedup.EMPTY).all() and (s[2] == near_dedup.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_url_filter(spark):
    urls = ["https://m.a.EXAMPLE.net/en/1?x", "http://example.net/de/", "http://b.example.com/de", "http://b.example.com/de/", None, "", "abc", "http://net/", "http://xnet/", "https://c.net", "http://x.org/fr/?://y", "://", "a://b.net/x?y#z", "http://x.org/fr/" + "a" * 50000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, rule string")

    def judged(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, "allow")))

    want = {i: judged(u) for i, u in enumerate(urls + urls[:1])}
    assert {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(df).collect()} == want
    assert {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(df, most=1).collect()} == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0 and url_filter.filter_urls(df, []).where("rule IS NOT NULL").count() == 0
    names, bits = url_filter.shipped(spark, url_filter.RULES, url_filter.PART)
    assert url_filter.shipped(spark, url_filter.RULES, url_filter.PART) == (names, 0) and len(names) == 2 and bits == 0
    assert url_filter.shipped(spark, url_filter.RULES, 1)[1] == 2 and len(url_filter.shipped(spark, url_filter.RULES, 1)[0]) > 2


def test_url_index(spark):
    """Any number of files gives the verdicts of a plain search, also for rules that differ in case only, for a table of rules, and when all digests collide."""
    r = np.random.default_rng(5)
    pick = lambda *x: str(r.choice(x))
    rules = [(pick("net", "NET", "a.net", "B.a.net", "org", "x.ORG", "é.ö") + pick("", "/", "/en/", "/EN/", "/en/x", "/ü/", "/e/n/"), pick("allow", "block")) for _ in range(60)]
    urls = ["http://" + pick("net", "c.NET", "a.net", "d.b.a.net", "x.org", "xorg", "a.é.ö", ".net", "net.", "a..net", "") + pick("", "/", "/en/", "/EN/", "/en/xyz", "/e?/en/", "/ü/é", "/e/n/") for _ in range(200)]

    def plain(u):
        host, path = url_filter.split_url(u)
        cut = [(x.partition("/")[0].translate(url_filter._fold), "".join(x.partition("/")[1:]), v) for x, v in rules]
        last = {h + p: (h, p, v) for h, p, v in cut}
        fit = [(len(x), len(h), x, v) for x, (h, p, v) in last.items() if ("." + host).endswith("." + h) and path.startswith(p) and host]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, ""])], "page_id long, url string")
    want = {i: x for i, x in enumerate([*map(plain, urls), ("", "", None, "allow"), ("", "", None, "allow")])}
    given = spark.createDataFrame([(i, x, v, "extra") for i, (x, v) in enumerate(rules)] + [(99, None, "block", "extra"), (98, "/en/", "block", ""), (97, "", "block", "")], "seq int, rule string, verdict string, host string").repartition(5)
    for most in (1, 7, 1000):
        for some in (rules, given):
            assert {x.page_id: tuple(x)[1:] for x in url_filter.filter_urls(df, some, most=most).collect()} == want
    equal = spark.createDataFrame([("net/", "allow"), ("NET/", "block")], "rule string, verdict string")
    assert {x.verdict for x in url_filter.filter_urls(df.where("url LIKE 'http://net/%'"), equal).collect()} == {"block"}
    with pytest.raises(Exception, match="neither allow nor block"):
        url_filter.filter_urls(df, [("net/", "maybe")]).count()
    texts, digests = ["a", "b", "net/"], np.array([3, 1, 2], np.uint64)
    part = url_filter.DigestTable(np.frombuffer(url_filter.DigestTable.packed(digests, texts, [[1], [], [2, 3]]), np.uint8))
    assert part.keys.tolist() == [1, 2, 3] and [(part.string(j), part.of(j)) for j in range(3)] == [(b"b", []), (b"net/", [2, 3]), (b"a", [1])]
    part.keys = np.full(part.n, part.keys[0])
    wanted = [part.string(j) for j in range(part.n)]
    assert list(part.find(wanted, part.keys)) == list(range(part.n)) and list(part.find([b"none"], part.keys[:1])) == [-1]


def plain_base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, odd, none):
    model = quality_rules.fit_rules(docs, table(spark, "labels"))
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in ODD])):
        got = {r.doc_id: r for r in quality_rules.apply_rules(df, model).collect()}
        for i, text in rows:
            r, want = got[i], plain_base(text)
            assert tuple(r)[1:6] == want and r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(none, model).count() == 0 and quality_rules.fit_rules(none, table(spark, "labels")).score(np.zeros((1, 14)))[0] == 0.5
    good = {r.doc_id for r in table(spark, "labels").where("quality = 1").collect()}
    rows = [r for r in QUERIES["op8_quality_rules"](spark, SF).collect() if r.doc_id in good and not r.base_failed]
    assert np.mean([r.kept for r in rows]) > 0.9


def plain_trees(model, x):
    total = model.base
    for at in model.roots:
        while model.left[at] != at:
            at = model.right[at] if x[model.feature[at]] > model.threshold[at] else model.left[at]
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def test_rules_equal_a_plain_tree_walk(spark, docs):
    model = quality_rules.fit_rules(docs, table(spark, "labels"))
    rows, texts = quality_rules.apply_rules(docs, model).collect(), {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        x = quality_rules.statistics(texts[r.doc_id])[1]
        assert abs(r.score - plain_trees(model, x)) < 1e-9 and r.kept == (not r.base_failed and plain_trees(model, x) >= quality_rules.KEEP)


def test_boosting_is_monotone():
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) + 0.2 * r.normal(size=600)) > 0.5).astype(float)
    m = boosting.fit(x, y, np.array([1, -1, 0]))
    line = np.full((200, 3), 0.5)
    line[:, 0] = np.linspace(0, 1, 200)
    assert (np.diff(m.score(line)) >= -1e-12).all() and ((m.score(x) > 0.5) == y).mean() > 0.8
    line[:, 1] = line[:, 0].copy()
    line[:, 0] = 0.5
    assert (np.diff(m.score(line)) <= 1e-12).all()


def test_media(spark, odd, none):
    rows = QUERIES["op9_media_columns"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for got, want in ((rows, texts), (media.read_back(media.store_texts(odd)).collect(), {r[0]: r[1] for r in ODD})):
        for r in got:
            b = (want[r.doc_id] or "").encode()
            p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert r.media_sha256 == hashlib.sha256(media.mux(p)).hexdigest() and f"samples={len(p) // 576};" in r.feature
    assert media.read_back(media.store_texts(none)).count() == 0
    c = media.mux(b"a" * 576 * 30)
    df = spark.createDataFrame([(1, bytearray(c)), (2, None), (3, bytearray(b"")), (4, bytearray(c[:-9])), (5, bytearray(b"\0\0\0\4xxxx"))], "k long, c binary")
    got = {r.k: r for r in media.media_columns(df, "k", "c").collect()}
    assert [(k.start, k.end) for k in got[1].tracks[0].keyframes] == [(32 + 576 * i, 608 + 576 * i) for i in (0, 12, 24)] and got[1].tracks[0].duration == 30
    assert not got[2].tracks and not got[2].error and not got[3].tracks and got[4].error and got[5].error


def test_damaged_containers(spark):
    """Whatever is cut off or changed, a container gives tracks or an error, and no task fails or allocates by a false count."""
    r = np.random.default_rng(7)
    good = media.mux(b"a" * 576 * 40)
    data = [good[: int(n)] for n in r.integers(0, len(good), 60)]
    for _ in range(600):
        b = bytearray(good)
        for at in r.integers(32 + 576 * 40 - 8, len(good), r.integers(1, 5)):
            b[at] = r.choice([0, 1, 127, 255, r.integers(256)])
        data.append(bytes(b))
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    huge = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", media.full(b"stsz", (1).to_bytes(4, "big") + (2**32 - 1).to_bytes(4, "big")))))))
    data += [media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd")))), deep, huge]
    rows = media.media_columns(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "k long, c binary"), "k", "c").collect()
    assert len(rows) == len(data) and all(not (x.error and x.tracks) for x in rows) and all(x.error for x in rows[-3:])
    assert sum(bool(x.error) for x in rows) > 100


def test_mutated_containers():
    """Of thousands of changed containers, with tables or fragments, each gives tracks or ValueError."""
    r, good = np.random.default_rng(11), [media.mux(b"a" * 576 * 3), fragmented()]
    for n in range(6000):
        b = bytearray(good[n % 2])
        for at in r.integers(0, len(b), r.integers(1, 6)) if n % 2 else [*r.integers(32 + 576 * 3, len(b), r.integers(1, 6))]:
            b[at] = r.choice([0, 1, 2, 8, 127, 128, 255, r.integers(256)])
        try:
            for t in media.walk(bytes(b)):
                media.samples(bytes(b), t), media.feature(t)
        except ValueError:
            pass
    far = bytearray(fragmented(base=2**63))
    with pytest.raises(ValueError, match="base"):
        media.walk(bytes(far))


def fragmented(base=None):
    import struct

    entry = media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(20)))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(68)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), media.box(b"minf", media.box(b"stbl", entry))))
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 2, 3, 0x10000))))
    run = media.full(b"trun", struct.pack(">IiIIII", 3, 8, 0, 5, 6, 7), flags=0x205)
    head = media.full(b"tfhd", struct.pack(">IQ", 7, len(moov) if base is None else base), flags=0x1)
    return moov + media.box(b"moof", media.box(b"traf", head, run)) + media.box(b"mdat", b"aaaaabbbbbbccccccc")


def test_movie_fragments():
    import struct

    entry = media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(20)))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(68)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), media.box(b"minf", media.box(b"stbl", entry))))
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 2, 3, 0x10000))))

    def moof(offset):
        run = media.full(b"trun", struct.pack(">IiIIII", 3, offset, 0, 5, 6, 7), flags=0x205)
        return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run))

    first = moof(len(moof(0)) + 8)
    data = moov + first + media.box(b"mdat", b"aaaaabbbbbbccccccc")
    (t,) = media.walk(data)
    assert media.samples(data, t) == b"aaaaabbbbbbccccccc" and t["duration"] == 6 and t["timescale"] == 10 and [b - a for a, b in t["keyframes"]] == [5]
    with pytest.raises(ValueError):
        media.walk(data[:-3] + b"")
    sizes = media.full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", 3), bytes([0x12, 0x30]))
    assert list(media.few_bits(memoryview(sizes), 8, len(sizes))) == [1, 2, 3]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] > most * sizes[s]}
        if not full:
            out |= {s: unit * w[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mixing(spark, docs, odd, none):
    for df in (docs, odd):
        src, size = {}, Counter()
        for r in df.select("source", "text").collect():
            size[r.source] += len(WORD.findall(r.text or ""))
        rows = mixing.plan(df).collect()
        want, taken = plain_targets(dict(size)), Counter()
        assert len(rows) == df.count()
        for r in rows:
            assert abs(r.target - want[r.source]) < 1e-3 and r.source_size == size[r.source] and r.taken == r.size * r.copies <= 3 * r.size
            assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
            taken[r.source] += r.taken
            src.setdefault(r.source, []).append(r.size)
        assert all(abs(taken[s] - want[s]) <= max(src[s]) / 2 + 1 for s in want)
        key = lambda rs: sorted((str(r.doc_id), r.size, tuple(r.positions)) for r in rs)
        assert key(rows) == key(mixing.plan(df.repartition(5)).collect())
    assert mixing.plan(none).count() == 0
    order = [r.position for r in mixing.in_order(mixing.plan(docs)).collect()]
    assert order == sorted(order)


def test_mixing_takes_large_documents_as_others(spark):
    """A source's large documents are taken for the same share as its small ones, and null and repeated ids are dealt by their texts."""
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(n), s) for s in "abc" for i, n in enumerate([*r.integers(150, 400, 40), *r.integers(5, 40, 800)])]
    rows += [(None, f"w x{i}", "c") for i in range(300)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("target < source_size AND size > 0").withColumn("large", F.expr("size * 100 > source_size"))
    seen = {(x.source, x.large): x.share for x in got.groupBy("source", "large").agg((F.sum("taken") / F.sum("size")).alias("share")).collect()}
    want = {x.source: x.target / x.source_size for x in got.select("source", "target", "source_size").distinct().collect()}
    assert len(want) >= 1 and all(abs(v - want[s]) < 0.06 for (s, _), v in seen.items()) and any(k for _, k in seen)
    places = got.where("copies > 0").select("large", F.explode("positions").alias("p")).groupBy("large").agg(F.avg("p").alias("m")).collect()
    assert all(0.25 < x.m < 0.75 for x in places)


def test_schedule_inversion(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        grid = np.linspace(0, 1, 100001)
        w = np.interp(grid, [a for a, _ in knots], [b for _, b in knots])
        total = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        shares = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999]
        df = spark.createDataFrame([(k, s) for s in shares], "k int, s double").select("s", mixing.position(F.col("k"), F.col("s")).alias("p"))
        assert all(abs(r.p - np.interp(r.s * total[-1], total, grid)) < 1e-4 for r in df.collect())


def test_pipeline_packs_in_the_order_of_the_mix(spark, tmp_path):
    """Later files are larger, and scans take large ones first; a text of many pieces keeps their order."""
    rows = [(i, "w x y " * (i * i + 1)) for i in range(60)]
    path = f"file://{tmp_path}/mix"
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    got = corpus_pipeline.packed(spark, spark.read.parquet(path), SF).orderBy("sequence_id").collect()
    at = [(r.doc_id, r.start) for r in got]
    assert at == sorted(at) and {i for i, _ in at} == set(range(60)) and len({r.sequence_id for r in got}) == len(got)
    check_pieces(got, rows)


def plain_mix(rows):
    """[(doc_id, text, position)] of the copies that a mix of rows (doc_id, text, source) takes, with positions from the schedules on a fine grid."""
    size = Counter()
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    for _, _, s, n in rows:
        size[s] += n
    goal, out = plain_targets(dict(size)), []
    for kind, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode()))):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest())
        passes = int(round(goal[s], 6) // size[s]) if size[s] else 0
        rest, last = round(goal[s], 6) - passes * size[s], set()
        large = [k for k, r in enumerate(own) if r[3] * 100 > size[s]]
        small = [k for k, r in enumerate(own) if r[3] and k not in set(large)]
        for part, left in ((large, rest / size[s] * sum(own[k][3] for k in large) if size[s] else 0), (small, None)):
            left, at = rest - sum(own[k][3] for k in last) if left is None else left, 0
            for k in part:
                if at + own[k][3] / 2 < left:
                    last.add(k)
                at += own[k][3]
        grid = np.linspace(0, 1, 200001)
        w = np.interp(grid, [a for a, _ in mixing.SCHEDULES[kind % 3]], [b for _, b in mixing.SCHEDULES[kind % 3]])
        spent = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        at = 0
        for k, (i, t, _, n) in enumerate(own):
            out += [(i, t, float(np.interp(min(1, (at + c * size[s]) / max(goal[s], 1)) * spent[-1], spent, grid))) for c in range(passes + (k in last) if n else 0)]
            at += n
    return out


def test_pipeline_run_equals_brute_force(spark, docs):
    """All stages in plain Python, from the network's scores to pieces, their ids, and their order in training."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = corpus_pipeline.run(spark, SF).orderBy("sequence_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    net, plain = byte_cnn.fit_network(docs, table(spark, "labels")), PlainFeistel(pii.DEFAULT_KEY)
    import regex

    found = regex.compile(pii.FOUND.replace("(?<gap>", "(?P<gap>").replace("(?<sep>", "(?P<sep>").replace(r"\k<gap>", "(?P=gap)").replace(r"\k<sep>", "(?P=sep)"), regex.ASCII)
    rows = [r for r in docs.collect() if net.score([r.text])[0] >= 0.3]
    alone = brute_groups([(r.doc_id, r.text) for r in rows], 5, 80)
    mix = plain_mix([(r.doc_id, found.sub(lambda m: plain(m[0]), r.text), r.source) for r in rows if alone[r.doc_id][1] == r.doc_id])
    assert len(mix) > 50
    check_pieces(got, [(i, t) for i, t, _ in mix])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    place = defaultdict(list)
    for i, _, p in mix:
        place[i].append(p)
    met, at = Counter(), []
    for r in got:  # a document's copies come in order, and its pieces side by side
        if r.start == 0:
            at.append(sorted(place[r.doc_id])[met[r.doc_id]])
            met[r.doc_id] += 1
    assert len(at) == len(mix) and all(a <= b + 1e-4 for a, b in zip(at, at[1:], strict=False))


def test_pipeline(spark, docs, odd, none, tmp_path):
    own = ("score", "predicted", "h", "size", "__found", "kept", "position", "id")
    for df in (docs, none, odd.select("doc_id", "text", "lang", "source", "n_chars", *own)):
        at = df
        texts = {}
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = at
            stage(spark, at, SF).write.parquet(f"file://{tmp_path}/{df.count()}-{i}")
            at = spark.read.parquet(f"file://{tmp_path}/{df.count()}-{i}")
            if name != "packing":
                assert at.columns == df.columns and at.where(" OR ".join(f"{c} <> 'other'" for c in own if c in df.columns) or "false").isEmpty()
            if name == "quality classifier":
                assert at.count() <= before.count()
            elif name == "MinHash near-dedup":
                want = brute_groups([(r.doc_id, r.text) for r in {r.doc_id: r for r in before.collect()}.values()], 5, 80)
                assert sorted(r.doc_id for r in at.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
            elif name == "PII":
                assert at.count() == before.count()
            elif name == "mixing":
                plan = {r.doc_id: r.copies for r in mixing.plan(before).collect()}
                assert Counter(r.doc_id for r in at.collect()) == Counter({k: v for k, v in plan.items() if v})
                texts = [(r.doc_id, r.text) for r in at.collect()]
            else:
                check_pieces(at.collect(), texts)
