import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coursemetrics.llm import pii, queries

KEY = "k"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(docs_of, texts, key=KEY):
    got = pii.replace_pii(docs_of(list(enumerate(texts))), key, count_col="n").collect()
    return [next((r.text, r.n) for r in got if r.doc_id == i) for i in range(len(texts))]


def shape(s):
    return re.sub("[a-zà-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", s)))


def test_formats_are_kept(docs_of):
    texts = ["mail Pa.90@Mail2.example.com now", "ip 97.51.17.173.", "card 4111 1111 1111 1111 or 4111111111111111 end", "call +1 (974) 555-3436, 212-555-0100!",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00"]
    got = run(docs_of, texts)
    assert [n for _, n in got] == [1, 1, 2, 2, 1, 2]
    for old, (new, _) in zip(texts, got):
        assert new != old and len(new) == len(old)
        if "token" not in old:
            assert shape(new) == shape(old)
    assert re.search(r"\+1 \(", got[3][0]) and re.search("[0-9a-f]{40}", got[4][0])
    spaced, plain = re.findall(r"\d[\d ]{14,18}\d", got[2][0])
    assert luhn(spaced) and spaced.replace(" ", "") == plain and plain[:2] == "41"  # one entity in two spellings
    assert all(0 < int(x) < 256 for x in re.search(r"[\d.]+\d", got[1][0])[0].split("."))


def test_names_keep_gender_script_and_coreference(docs_of):
    (a, n), (b, _), (c, _), (d, m) = run(docs_of, ["Mrs. Maria Lopez met Mr. Smith", "Ms Lopez and Herr Smith", "Мария Петрова", "the Maria is here. Mr is"])
    first, last = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)$", a).group(1, 2)
    assert n == 3 and first[-1] == "a" and last in b and re.search(r"Mr\. (\w+)", a)[1] == re.search(r"Herr (\w+)", b)[1]
    assert re.fullmatch(r"[А-Яа-я]+а [А-Яа-я]+|[А-Яа-я]+я [А-Яа-я]+", c) and "Мария" not in c and "Петрова" not in c
    assert (d, m) == ("the Maria is here. Mr is", 0)


def test_neighbours_are_entities_of_their_own(docs_of):
    texts = ["+1 (269) 555-3296 4111111111111111", "x 4111111111111111 y +1 (269) 555-3296", "+1 (608) 555-2280 37.92.11.12 +33 1 23 45 67 89", "+12695553296 4111111111111111."]
    got = run(docs_of, texts)
    assert [n for _, n in got] == [2, 2, 3, 2]
    assert got[0][0].split()[-1] == got[1][0].split()[1] == got[3][0].split()[-1].rstrip(".") and got[0][0][:17] == got[1][0][-17:]


def test_lookalikes_stay(docs_of):
    texts = ["9807915762804490 and 4845168114407328", "1.2.3 and 1.2.3.4.5 and 300.1.1.1", "a@b, @home, x@y", "2024-01-02 12:30 1,000,000", "DEADBEEF", None, "", " "]
    assert run(docs_of, texts) == [(t, 0) for t in texts]


def test_keys_differ_and_runs_agree(docs_of):
    texts = ["x und.34@mail7.example.com y"]
    assert run(docs_of, texts) == run(docs_of, texts) != run(docs_of, texts, "other")


def test_edge_tables(docs_of):
    assert pii.replace_pii(docs_of([]), KEY).count() == 0
    rows = [(None, "a b.1@mail1.example.com"), (1, "a b.1@mail1.example.com"), (1, "a b.1@mail1.example.com"), (2, "w " * 200_000 + "b.1@mail1.example.com")]
    got = pii.replace_pii(docs_of(rows), KEY).collect()
    assert len(got) == 4 and len({r.text[-22:] for r in got}) == 1 and got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "b.1@mail1.example.com", "x", "y")], "text_id long, text string, attempts string, kind string")
    got = pii.replace_pii(df, KEY).collect()[0]
    assert got.attempts == "x" and got.kind == "y" and got.text != "b.1@mail1.example.com"


def test_collisions_are_resolved(spark, docs_of):
    texts = [f"host {a}.{b}.{c}.{d} end" for a in range(1, 7) for b in range(1, 7) for c in range(1, 7) for d in range(1, 10)]
    got = run(docs_of, texts)
    old, new = [t.split()[1] for t in texts], [t.split()[1] for t, _ in got]
    assert len(set(new)) == len(old) and not set(new) & set(old) and all(len(x) == 7 for x in new)


def test_a_full_format_is_told(docs_of, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 2)
    with pytest.raises(ValueError, match="colliding"):
        run(docs_of, [f"{a}.{b}.{c}.{d}" for a in range(1, 9) for b in range(1, 9) for c in range(1, 9) for d in range(1, 9)])


PRIVATE = re.compile(r"[^\W_][\w.]*@[\w.-]+\.[a-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+(?:\.\d+){3}\b|\b[0-9a-f]{40}\b|\b4\d{15}\b", re.I)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_pii_surrogates(spark, sf).collect()}
    assert got.keys() == old.keys()
    forward, private = defaultdict(set), set()
    for i, text in old.items():
        a, b = PRIVATE.findall(text), PRIVATE.findall(got[i].text)
        a_only = [x for x in a if not x.isdigit() or luhn(x)]
        b_only = [y for x, y in zip(a, b) if not x.isdigit() or luhn(x)]
        assert len(a) == len(b) and got[i].n_replaced >= len(a_only)
        assert (got[i].text == text) == (got[i].n_replaced == 0) and (not b or len(got[i].text) == len(text))
        private |= set(a_only)
        for x, y in zip(a_only, b_only):
            forward[x].add(y)
    made = [y for ys in forward.values() for y in ys]
    assert private and all(len(ys) == 1 for ys in forward.values()) and len(set(made)) == len(made) and not private & set(made)
    assert not any(p in r.text for p in private for r in got.values())


def test_no_python_in_the_plan(docs_of):
    plan = pii.replace_pii(docs_of([(1, "a b.1@mail1.example.com")]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_hint_is_passed_by_every_entity(spark):
    shown = ["a.1@b.example", "0" * 32, "ABCDEF" * 6 + "0", "AKIA" + "A" * 15 + "7", "ghp_" + "a" * 35 + "1", "sk-" + "a" * 20 + "3", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111",
             "1.2.3.4", "123-45-6789", "+33 1 23 45 67", "(212) 555-0100", "212-555-0100", "Mr. Smith", "Dr Who", "Maria Lopez"]
    df = spark.createDataFrame([(x,) for x in shown], "t string")
    assert df.where(F.col("t").rlike(f"^(?:{pii.ANY})$")).count() == len(shown) == df.where(F.col("t").rlike(pii.HINT)).count()


def test_full_formats_get_longer_surrogates(docs_of, monkeypatch):
    """Every name of a format is taken by a real entity, so no surrogate of that format is left."""
    monkeypatch.setattr(pii, "WIDE_FROM", 3)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba"] * 8 + ["ko"] * 8)  # 32 surnames in place of 16,384
    mails = [f"{c}@gmail.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{d}@mail.example" for d in range(10)]
    names = [f"{a}{b}" for a in "BCDFGHKL" for b in ("ach", "eld", "ink", "old", "und", "yth")]
    texts = [*mails, *(f"Mr. {x}" for x in names)]
    got = run(docs_of, texts)
    assert [n for _, n in got] == [1] * len(texts)
    new = [t for t, _ in got]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert all(re.fullmatch(r"[a-z0-9]+@(?:gmail\.com|mail\.example)", t) for t in new[:len(mails)])


def test_late_surrogates_have_room(spark):
    """The room of a short host or number is 6,561 and 800 in its own format."""
    for kind, value in (("ip", "1.2.3.4"), ("phone", "+7 2 34"), ("surname", "Smith"), ("email", "a@gmail.com")):
        late = spark.range(900).select(pii.surrogate(KEY, F.lit(kind), F.lit(value), F.col("id") + pii.WIDE_FROM).alias("x")).distinct().collect()
        assert len(late) > 895
        assert kind != "ip" or all(0 < int(n) < 256 for r in late for n in r.x.split("."))


def rest_97(iban):
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_account_numbers_have_check_digits(docs_of):
    real = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606"]
    wrong = ["DE88 3704 0044 0532 0130 00", "GB82WEST12345698765431"]
    assert all(rest_97(x) == 1 for x in real) and not any(rest_97(x) == 1 for x in wrong)
    got = run(docs_of, [f"pay {x} now" for x in real] + [f"pay {x} now" for x in wrong])
    for old, (new, n) in zip(real, got):
        made = new[4:-4]
        assert n == 1 and made != old and rest_97(made) == 1 and shape(made) == shape(old) and made[:2] == old[:2]
    assert [t for t, _ in got[len(real):]] == [f"pay {x} now" for x in wrong]


def test_more_spellings(docs_of):
    """National numbers with dots or spaces, both kinds of IP address, the shortest account numbers."""
    texts = ["a 212.555.0100 b", "a 212 555 0100 b", "a (212)555.0100 b", "a (212).555-0100 b", "a 2001:0db8:85a3:0000:0000:8a2e:0370:7334 b", "a 2001:DB8::8A2E:370 b", "a fe80::1 b",
             "a NO93 8601 1117 947 b", "a NO9386011117947 b"]
    got = run(docs_of, texts)
    for old, (new, n) in zip(texts, got):
        assert n == 1 and new != old and len(new) == len(old) and new[:2] == "a " and new[-2:] == " b"
        assert ":" in old or shape(new) == shape(old)
    assert [re.sub("[0-9a-fA-F]", "h", t) for t, _ in got[4:7]] == [re.sub("[0-9a-fA-F]", "h", t) for t in texts[4:7]]
    assert got[4][0][2:7] == "2001:" and got[5][0][2:7] == "2001:" and got[6][0][2:7] == "fe80:" and got[5][0][2:-2] == got[5][0][2:-2].upper()
    assert got[0][0] != got[1][0] and re.sub(r"\D", "", got[0][0]) == re.sub(r"\D", "", got[1][0])  # one number in two spellings
    assert rest_97(got[7][0][2:-2]) == 1 and got[7][0].replace(" ", "") == got[8][0].replace(" ", "")


def test_more_lookalikes_stay(docs_of):
    texts = ["1.212.555.0100 and 212.555.0100.7", "100.200.3000 and 212 155 0100", "of 212 555 0100 2 rows", "at 12:30:45 std::vector a::b", "00:1A:2B:3C:4D:5E and 1:2:3:4:5:6:7:8:9",
             "NO92 8601 1117 947"]
    assert run(docs_of, texts) == [(t, 0) for t in texts]


def test_late_addresses_have_room(spark):
    late = spark.range(900).select(pii.surrogate(KEY, F.lit("ip"), F.lit("fe80::1"), F.col("id") + pii.WIDE_FROM).alias("x")).distinct().collect()
    assert len(late) > 895 and all(re.fullmatch(r"fe80::[0-9a-f](?::[0-9a-f]{4}){2}", r.x) for r in late)
