import base64
import quopri
import random

from spanweave.llm import leaks, mail

PASSAGE = "Two pupils pour vapour over a fragile ledger inside a tent and wait 30 minutes before noon"
ITEM = PASSAGE + ". They note that it erodes."


def items(spark, extra=()):
    return spark.createDataFrame([(1, ITEM), (2, "too short to leak"), (3, None), (4, ""), *extra], "item_id long, text string")


def b64(text, charset="utf-8"):
    raw = base64.b64encode(text.encode(charset)).decode()
    return "\n".join(raw[i : i + 60] for i in range(0, len(raw), 60))


def qp(text):
    return quopri.encodestring(text.encode()).decode()


HEAD = "From: a@b.example\nSubject: note\n"
HIDDEN = PASSAGE.replace("minutes", "mi​nutes").replace("fragile", "fra­gile")
QUOTED = "\n".join("> KO> " + " ".join(w) for w in zip(*[iter(PASSAGE.split())] * 4))
HTML = "<html><style>x</style><body><p>" + PASSAGE.replace("pupils", "pu<b>pil</b>s").replace(" over ", "&nbsp;over<br>") + "</p></body></html>"
TEXTS = {
    "plain": PASSAGE,
    "header and body": HEAD + "\n" + PASSAGE,
    "crlf": (HEAD + "\n" + PASSAGE.replace(" ", "\n")).replace("\n", "\r\n"),
    "base64": HEAD + "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + b64("x " + PASSAGE + " y"),
    "cut base64": HEAD + "Content-Transfer-Encoding: BASE64\n\n" + b64(PASSAGE + " and more words")[:-3],
    "quoted-printable": HEAD + "Content-Transfer-Encoding: quoted-printable\n\n" + qp("é " * 20 + PASSAGE.replace(" ", "  ")),
    "html": HEAD + "Content-Type: text/html; charset=iso-8859-1\n\n" + HTML,
    "multipart": HEAD + 'Content-Type: multipart/mixed;\n boundary="=-1-x"\n\nignored\n--=-1-x\nContent-Type: multipart/alternative; boundary=in\n\n--in\n\nhello\n--in\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n' + b64(HTML) + "\n--in--\n--=-1-x\nContent-Type: application/octet-stream\n\nno",
    "attachment": HEAD + 'Content-Type: multipart/mixed; boundary="q"\n\n--q\n\nhello\n--q\nContent-Type: text/csv\nContent-Disposition: attachment; filename="a.csv"\n\n' + PASSAGE.replace(" ", ","),
    "subject": f"Subject: =?utf-8?B?{base64.b64encode(PASSAGE[:40].encode()).decode()}?=\n =?utf-8?q?{PASSAGE[40:].replace(' ', '_')}?=\n\nhello",
    "folded subject": "Subject: " + PASSAGE.replace(" over", "\n over") + "\n\nhello",
    "no width": HEAD + "\n" + HIDDEN,
    "quoted with initials": HEAD + "\n" + QUOTED,
    "forwarded": HEAD + "Content-Type: message/rfc822\n\n" + HEAD + "\n" + PASSAGE,
    "upper case": PASSAGE.upper(),
    "twelve words": " ".join(PASSAGE.split()[2:14]),
}
CLEAN = {
    "eleven words": " ".join(PASSAGE.split()[:11]) + " other " + " ".join(PASSAGE.split()[12:]),
    "over two parts": HEAD + "Content-Type: multipart/mixed; boundary=q\n\n--q\n\n" + PASSAGE[:50] + "\n--q\n\n" + PASSAGE[50:] + "\n--q--",
    "after the end": HEAD + "Content-Type: multipart/mixed; boundary=q\n\n--q\n\nx\n--q--\n" + PASSAGE,
    "unread part": HEAD + "Content-Type: application/octet-stream\n\n" + PASSAGE,
    "still encoded": HEAD + "\n" + b64(PASSAGE),
    "comment": HEAD + "Content-Type: text/html\n\n<!-- " + PASSAGE + " -->",
    "empty": "", "null": None, "blank": "\n\n", "header only": "Subject: x", "no boundary": HEAD + "Content-Type: multipart/mixed\n\n--q\nx", "broken": "Content-Type: ;;=\n\n=?x?=",
}


def test_messages(spark, monkeypatch):
    names = [*TEXTS, *CLEAN]
    docs = spark.createDataFrame([(i, (TEXTS | CLEAN)[n], 7) for i, n in enumerate(names)], "doc_id long, text string, item_id int")
    got = {names[r.doc_id] for r in leaks.find_leaks(docs, items(spark)).collect()}
    assert got == set(TEXTS)
    kept = {names[r.doc_id] for r in leaks.without_leaks(docs, items(spark)).collect()}
    assert kept == set(CLEAN)
    parts = leaks.without_passages(docs, items(spark)).collect()
    assert {names[r.doc_id] for r in parts if r["items"]} == set(TEXTS)
    again = spark.createDataFrame([(i, r.text) for i, r in enumerate(parts)], "doc_id long, text string")
    assert leaks.find_leaks(again, items(spark)).count() == 0
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", 10)
    assert {names[r.doc_id] for r in leaks.find_leaks(docs, items(spark)).collect()} == set(TEXTS)


def test_shared_passages_repeats_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE + "\n" + PASSAGE), (1, PASSAGE), (2, "x " * 100_000 + PASSAGE)], "doc_id long, text string")
    more = items(spark, [(5, "Before this: " + PASSAGE)])
    assert sorted(tuple(r) for r in leaks.find_leaks(docs, more).collect()) == [(1, 1), (1, 1), (1, 5), (1, 5), (2, 1), (2, 5)]
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", 10)
    assert sorted(tuple(r) for r in leaks.find_leaks(docs, more).collect()) == [(1, 1), (1, 5), (2, 1), (2, 5)]
    assert leaks.find_leaks(docs.limit(0), more).count() == 0
    assert leaks.find_leaks(docs, more.limit(0)).count() == 0


def test_scan_equals_brute_force():
    rng = random.Random(8)
    words = ["a", "b", "c"]
    for _ in range(300):
        some = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(3)]
        text = " ".join(rng.choices([*words, "z"], k=rng.randint(0, 30)))
        grams, known = leaks._runs(some, 4)
        want = {i for i, x in some if any(f" {' '.join(x.split()[j : j + 4])} " in f" {text} " for j in range(len(x.split()) - 3))}
        assert leaks.leaked_items(text, grams, known, 4) == want


def test_reader_never_fails():
    rng = random.Random(9)
    parts = ["Content-Type: ", "multipart/mixed; boundary=q", "\n", "\n\n", "--q", "--q--", "text/html", "<b", ">", "&#", "=?utf-8?b?", "?=", "=E9", "\r", "base64", "Content-Transfer-Encoding: ", "Subject: ", "é", "\0", "> A> "]
    for _ in range(3000):
        mail.readable("".join(rng.choices(parts, k=rng.randint(0, 25))))


def test_deep_parts_and_absent_boundaries(spark):
    mixed = 'Content-Type: multipart/mixed; boundary="b{0}"\n\n--b{0}\n'
    deep = HEAD + "".join(mixed.format(i) for i in range(40)) + "Content-Transfer-Encoding: base64\n\n" + b64(PASSAGE)
    far = HEAD + "Content-Type: message/rfc822\n\n" * 3000 + HEAD + "\n" + PASSAGE
    absent = HEAD + "Content-Type: multipart/mixed; boundary=q\n\n" + PASSAGE
    docs = spark.createDataFrame([(1, deep), (2, far), (3, absent), (4, HEAD)], "doc_id long, text string")
    assert {r.doc_id for r in leaks.find_leaks(docs, items(spark)).collect()} == {1, 2, 3}
    assert [r.doc_id for r in leaks.without_leaks(docs, items(spark)).collect()] == [4]
    assert mail.readable(HEAD + mixed.format(1) + "\nx\n--b1\nContent-Type: message/rfc822\n\nSubject: s\n\ny\n--b1\n\nz") == ["note", "x", "s", "y", "z"]


def test_initials_at_any_depth():
    assert mail.readable("AB> " * 60 + "one\n>> ab>cd> two, but x > y") == [">  one\n>  two, but x > y"]


def test_cleaned_spans():
    grams, known = leaks._runs([(1, "a b c d e"), (2, "c d e f")], 3)
    assert leaks.cleaned("x \u0130 A, b c D e; F! y a b", grams, known, 3) == ("x \u0130 ! y a b", [1, 2])
    assert leaks.cleaned("a b c z d e f a b c", grams, known, 3) == (" z  ", [1, 2])
    assert leaks.cleaned("c d a b c e", grams, known, 3) == ("", [1, 2])
    assert leaks.cleaned("", grams, known, 3) == ("", [])
