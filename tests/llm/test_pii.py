"""Spans against the plain patterns in Python's re, and disclosing terms on a small corpus."""

import re

from pyspark.sql import functions as F

from tidemark.llm.pii import Disclosure, find_personal_data, sanitise

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if valid(kind, m.group())]
    return [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found)]


ODD = [
    None, "", "   ", "a@b.c-d_e@f.gg", "x@y", "é\U0001F600 a.b+c@d-e.co.uk, next z@q.w.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.001.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 x +12", "4111111111111111" * 3, "9" * 500, "a" * 20000, "a@" * 3000, "5 -6 7-8", "+49 30 1234 5678 90 11 22 33",
    "a@b.cc@d.ee", "12.3.4.5.6", "378282246310005 6011000990139424", "\n\ttel:+4930123456789\n", "@", "a@b..c", "1-2-3.4.5.6",
]


def test_base_spans_match_the_plain_patterns(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)] + [(1, "", "x"), (1, "q@r.st", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = find_personal_data(df, keep=("doc_id", "text"))
    got = sorted((r["text"] or "", [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]]) for r in out.collect())
    assert got == sorted((t or "", plain_spans(t or "")) for _, t, _ in rows)


def test_base_spans_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["text"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] for r in find_personal_data(df, keep=("text",)).collect()}
    assert sum(map(len, got.values())) > 0
    assert all(spans == plain_spans(t or "") for t, spans in got.items())


def test_terms_that_disclose_an_entity_are_generalised(spark):
    near = [f"w{i} u{i} Zorro joe@x.org v{i} t{i}" for i in range(6)]
    far = [f"plain text number {i}" for i in range(40)]
    copies = ["aa bb Qelt ann@x.org cc dd"] * 5
    df = spark.createDataFrame(list(enumerate(near + far + copies + ["Zorro again"])), "doc_id long, text string")
    out = find_personal_data(df, keep=("doc_id", "text"), rule=Disclosure())
    texts = [r["s"] for r in out.select(sanitise(F.col("text"), F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert texts[0] == "w0 u0 [TERM] [EMAIL] v0 t0"
    assert texts[-1] == "[TERM] again"
    assert texts[-2] == "aa bb Qelt [EMAIL] cc dd"  # copies of one text prove nothing
    assert texts[6] == "plain text number 0"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_personal_data(df).count() == 0


def _sanitised(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = find_personal_data(df, keep=("doc_id", "text"))
    return [r["s"] for r in out.select(sanitise(F.col("text"), F.col("spans")).alias("s")).orderBy("doc_id").collect()]


def test_copies_do_not_hide_a_disclosing_term(spark):
    near = [f"w{i} u{i} Zorro joe@x.org v{i} t{i}" for i in range(6)]
    got = _sanitised(spark, near * 20 + [f"plain text number {i}" for i in range(40)] + ["Zorro again"])
    assert got[:120] == [f"w{i} u{i} [TERM] [EMAIL] v{i} t{i}" for i in range(6)] * 20
    assert got[-1] == "[TERM] again"


def test_terms_may_be_far_off_and_have_marks_and_digits(spark):
    far = "some words that stand in between. "
    near = [f"(Holloway{',;.!'[i % 4]} w{i} {far * 9} u{i} joe@x.org v{i} {far * 9} EMP-4411{':)?'[i % 3]}" for i in range(6)]
    copies = [f"aa bb Qelt ann@x.org cc dd ee {k}" for k in range(9)]
    got = _sanitised(spark, near + copies + [f"{far} number {i}" for i in range(60)] + ['"Holloway" and EMP-4411.'])
    assert got[-1] == '"[TERM]" and [TERM].'
    assert got[0].startswith("([TERM], w0 some words") and got[0].endswith("[TERM]:")
    assert "Qelt" in got[6] and got[20] == f"{far} number 5"


def test_many_matches_of_one_text(spark):
    text = " ".join(f"n{i}@h{i}.org {'x' * (i % 70)}" for i in range(1100))
    (r,) = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == plain_spans(text)


def test_disclosing_terms_against_brute_force(spark):
    """PMI over distinct texts, contexts of whole words however long, entities whatever their spelling; copies, ties and null ids."""
    import math
    import random

    rnd = random.Random(4)
    vocabulary = [f"t{i}x" for i in range(25)] + ["ü" * 60, "R2D2x", "7emp_77x"]
    rows = []
    for i in range(160):
        w = rnd.choices(vocabulary, k=rnd.randint(2, 9))
        kind = i % 4
        if kind == 0:
            w.insert(rnd.randint(0, len(w)), rnd.choice(["Ann@x.org", "ann@X.org"]))
            w.append("Holloway,") if rnd.random() < 0.9 else None
        elif kind == 1:
            w.insert(rnd.randint(0, len(w)), rnd.choice(["4111 1111 1111 1111", "4111-1111-1111-1111"]))
            w.append("(Brandt)")
        rows += [(i if i % 9 else None, " ".join(w))] * rnd.choice([1, 1, 3])
    term, word = re.compile(r"[^\W_](?:[^\x20\x09-\x0D]*[^\W_])?"), re.compile(r"[^\x20\x09-\x0D]+")
    texts = sorted({t for _, t in rows})
    terms = {t: set(term.findall(t)) for t in texts}
    held, mentions, contexts = {}, {}, {}
    for t in texts:
        for x in terms[t]:
            held[x] = held.get(x, 0) + 1
        own = {}
        for kind in ("email", "card"):
            found = [m for m in PLAIN[kind].finditer(t) if valid(kind, m.group())]
            for k, m in enumerate(found):
                c = (kind, m.group().lower() if kind == "email" else re.sub("[^0-9]", "", m.group()))
                before = word.findall(t[found[k - 1].end() if k else 0 : m.start()])[-3:]
                after = word.findall(t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)])[:3]
                own.setdefault(c, set()).add((tuple(before), tuple(after)))
        for c, at in own.items():
            mentions[c] = mentions.get(c, 0) + 1
            for x in terms[t]:
                if x.lower() not in c[1] and c[1] not in x.lower():
                    contexts.setdefault((c, x), []).append(at)
    n, want = len(texts), set()
    for (c, x), lists in contexts.items():
        if len(set().union(*lists)) >= 3 and len({a for k in contexts if k[0] == c for at in contexts[k] for a in at}) >= 3:
            pmi = math.log((len(lists) / n) / (mentions[c] / n * held[x] / n))
            if pmi >= 0.9 * -math.log(mentions[c] / n):
                want.add(x)
    got = {s["match"] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["spans"] if s["kind"] == "term"}
    assert want >= {"Holloway", "Brandt"}
    assert got == {x for x in want if not any(x in m for m in ("Ann@x.org", "ann@X.org"))}
