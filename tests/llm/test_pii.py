"""Places in written-out texts, placeholders, and what surrogates keep."""

import pytest

from drawloom.llm import pii

PARTS = [(g, "given", "en") for g in ("Colin", "Grace", "Mark", "Rose", "Jonas", "Thea")] + [("Rémi", "given", "fr"), ("Jürgen", "given", "de")]
PARTS += [(h + t, "family", "en") for h in ("Bran", "Dun", "Hex", "Ket", "Lor") for t in ("brill", "derby", "stead", "thorpe")] + [("Winter", "family", "en"), ("Lacrinel", "family", "fr")]
NAMES = pii.Names([p for p in PARTS if p[0] != "Hexderby"])

CASES = [
    ("Mail <c.dun+x@lab.example.org> or kira dot bran at lab dot test.", [("email", "c.dun+x@lab.example.org"), ("email", "kira dot bran at lab dot test")]),
    ("owen [at] mail [dot] example [dot] com, a(at)b.invalid, x @ desk.example", [("email", "owen [at] mail [dot] example [dot] com"), ("email", "a(at)b.invalid"), ("email", "x @ desk.example")]),
    ("ssh ops@rig-15:/srv, @njit(cache=True), core@0.16.2, 3.2@0.75", []),
    ("Call +1 (212) 555-0188 ext. 12, (030) 23125-940 or tel. 4155550152; 020 7946 0131", [("phone", "+1 (212) 555-0188 ext. 12"), ("phone", "(030) 23125-940"), ("phone", "4155550152"), ("phone", "020 7946 0131")]),
    ("job 415-555-0188-698, seed 4155550152, draws 678 102 048 005, chunk 953-07-5374, asset tag 85618833L, ticket S45-04-2210", []),
    ("SSN 962 49 8079, id 931-01-8142, DNI: 24.206.279-K, NINO QQ 62 05 90 C, passport no. X5X482263, INSEE 1 93 99 99 393 394 84", [("id_number", x) for x in ("962 49 8079", "931-01-8142", "24.206.279-K", "QQ 62 05 90 C", "X5X482263", "1 93 99 99 393 394 84")]),
    ("lives at 12 Hollow Oak St. Apt. 4B, 24168 Town. At 51, impasse des Trois Noyers, Ostwick", [("address", "12 Hollow Oak St. Apt. 4B"), ("address", "51, impasse des Trois Noyers")]),
    ("Alte Zollstr. 40b, Ort; Avda. Fenolar, n.º 617; Calle San Olar 529, 3.º B, Ort", [("address", "Alte Zollstr. 40b"), ("address", "Avda. Fenolar, n.º 617"), ("address", "Calle San Olar 529, 3.º B")]),
    ("400 Drive slots are free. The 15 Hour Close of trials. 16 Seed Lane Road maps. 8 Lane agreement", []),
    ("After Dr. Colin van Hexstead's idea, ROSE KETBRILL and Dunderby, Jonas met M. Lorstead", [("name", "Colin van Hexstead"), ("name", "ROSE KETBRILL"), ("name", "Dunderby, Jonas"), ("name", "M. Lorstead")]),
    ("thea hexderby wrote; Grace  Lorbrill-Dunstead; Unknownname Branthorpe; T. Winter", [("name", "thea hexderby"), ("name", "Grace  Lorbrill-Dunstead"), ("name", "Unknownname Branthorpe"), ("name", "T. Winter")]),
    ("Mark Seed ranges 39-310. Rose Pool and Stone Pool. Grace Period of 9. On May 23 it was winter.", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_places(text, want):
    assert sorted((k, text[s:e]) for k, s, e in pii.find_places(text, NAMES)) == sorted(want)


def test_null_empty_and_long_texts_are_linear():
    assert pii.find_places(None, NAMES) == [] == pii.find_places("", NAMES)
    for unit in ("a", "1", "a.b-", "1 2", "@", "+1 ", "Colin ", "dot ", "(", "Rose K", "rue de "):
        pii.find_places(unit * (200_000 // len(unit)), NAMES)


def test_masked_numbers_entities(spark):
    df = spark.createDataFrame([(1, "Colin Hexstead, a@b.test; Hexstead, Colin"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.masked for r in pii.places(df, "doc_id", "text", PARTS, mask=True).collect()}
    assert got == {1: "[NAME_1], [EMAIL_1]; [NAME_1]", 2: None, 3: ""}


def test_surrogates_keep_form_and_identity(spark):
    t = "Colin Hexstead (colin.hex@lab.example.org, +1 (212) 555-0188) met THEA KETBRILL. Hexstead, Colin: colin dot hex at lab dot example dot org"
    df = spark.createDataFrame([(1, t), (2, "SSN 962 49 8079 of Colin Hexstead"), (3, None), (4, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.surrogates(df, "doc_id", "text", PARTS, "k").collect()}
    assert got[3] is None and got[4] == "nothing"
    again = {r.doc_id: r.text for r in pii.surrogates(df, "doc_id", "text", PARTS, "k").collect()}
    assert again == got
    found = pii.find_places(got[1], NAMES)
    assert [k for k, _, _ in found] == [k for k, _, _ in pii.find_places(t, NAMES)]
    keys = [pii.entity_key(k, got[1][s:e]) for k, s, e in found]
    assert keys[0] == keys[4] and keys[1] == keys[5] and keys[3].split()[1] and got[1].count("(") == 2
    assert "Hexstead" not in got[1] and "Colin" not in got[1] and keys[0] in pii.fold(got[2])
    assert pii.surrogates(df, "doc_id", "text", PARTS, "other").collect() != list(got.items())


def test_collisions_are_told_apart(spark):
    few = [("Colin", "given", "en"), ("Hexstead", "family", "en"), ("Ketbrill", "family", "en")]
    df = spark.createDataFrame([("name", f"x{i} y{i}") for i in range(60)] + [("id_number", "1")] * 3 + [("id_number", str(i)) for i in range(10)], "kind string, entity string")
    rows = pii.replacements(df, "k", few).collect()
    assert len(rows) == 70 and len({(r.kind, r.replacement) for r in rows}) == 70


@pytest.mark.parametrize("ext", [" ext. 105", " ext 105", ", extension 105", " x105", " x 105", " poste 105", " Durchwahl 105", " int. 105", ""])
@pytest.mark.parametrize("number", ["512-555-0183", "+44 (0)20 7946 0131", "0044 20 7946 0131", "030 23125-940"])
def test_phones_with_an_extension_keep_letters_and_no_digits(number, ext):
    seen = number + ext
    assert [(k, seen[s:e]) for k, s, e in pii.find_places(seen, NAMES)] == [("phone", seen)]
    key = pii.entity_key("phone", seen)
    new = pii.render("phone", seen, "".join(str((int(c) + 1) % 10) for c in key))
    assert [c for c in new if not c.isdigit()] == [c for c in seen if not c.isdigit()]
    assert pii.entity_key("phone", new) == "".join(str((int(c) + 1) % 10) for c in key)


def test_rendered_surrogates_of_full_forms_differ(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    seen = {"email": [f"{a}@{b}.test" for a in letters for b in letters], "phone": [f"512-555-{i:04d}" for i in range(0, 10_000, 7)], "id_number": [f"{i}-1" for i in range(10)]}
    rows = [(k, s, pii.entity_key(k, s)) for k, x in seen.items() for s in x]
    new = {(r.kind, r.entity): r.replacement for r in pii.replacements(spark.createDataFrame([(k, e) for k, _, e in rows], "kind string, entity string"), "k", PARTS).collect()}
    assert len({(k, pii.render(k, s, new[k, e])) for k, s, e in rows}) == len(rows)
    # phones of one prefix
    assert len({pii.candidate("phone", f"0{i:07d}", 0, b"k", {}) for i in range(0, 10_000_000, 997)}) == len(range(0, 10_000_000, 997))


def test_letters_keep_their_script():
    import unicodedata

    script = lambda s: [unicodedata.name(c).split()[0] if c.isalpha() else c for c in s]
    for s in ("иван.петров@пример.test", "νικος@δοκιμη.test", "josé.muñoz@exämple.test", "משה@example.test", "straße@example.test"):
        key = pii.entity_key("email", s)
        new = pii.render("email", s, pii.candidate("email", key, 0, b"k", {}))
        assert new != s and new.endswith(".test") and script(pii.entity_key("email", new)) == script(key)
        assert [c in "áàâäéèêëíìîïóòôöúùûüçñ" for c in pii.entity_key("email", new)] == [c in "éñä" for c in key]
    assert script(pii.candidate("address", "улица 12", 0, b"k", {})) == [*script("улица"), " ", *pii.candidate("address", "улица 12", 0, b"k", {})[-2:]]


def test_initials_are_the_one_full_name_they_fit(spark):
    keys = lambda t: [p["entity"] for p in pii.entities(t, NAMES)]
    assert keys("Colin Hexstead wrote. C. Hexstead signed, then Hexstead, C. and T. Hexstead") == ["colin hexstead"] * 3 + ["t hexstead"]
    assert keys("Colin Hexstead, Claire Hexstead and C. Hexstead")[-1] == "c hexstead"
    assert pii.render("name", "C. Hexstead", "grace lorderby") == "G. Lorderby" and pii.render("name", "HEXSTEAD, C.", "grace lorderby") == "LORDERBY, G."
    df = spark.createDataFrame([(1, "Colin Hexstead wrote and C. Hexstead signed")], "doc_id long, text string")
    a, b = pii.surrogates(df, "doc_id", "text", PARTS, "k").first().text.replace(" signed", "").split(" wrote and ")
    assert b == f"{a[0]}. {a.split()[-1]}"


def test_replacements_are_no_entities_of_the_corpus(spark):
    """All names that the pools can give are entities themselves, and all numbers of a form: larger spaces are drawn from."""
    pools = [p for p in PARTS if p[0] in ("Colin", "Thea", "Hexstead", "Ketbrill", "Dunderby")]
    rows = [("name", f"{g} {f}") for g in ("colin", "thea") for f in ("hexstead", "ketbrill", "dunderby")] + [("id_number", str(i)) for i in range(10)] + [("address", f"{c} st") for c in "abcdefghijklmnopqrstuvwxyz"]
    new = {(r.kind, r.entity): r.replacement for r in pii.replacements(spark.createDataFrame(rows, "kind string, entity string"), "k", pools).collect()}
    assert set(new) == set(rows)
    assert len({(k, v) for (k, _), v in new.items()}) == len(rows) and not {(k, v) for (k, _), v in new.items()} & set(rows)
    assert all(pii.entity_key(k, pii.render(k, e, v)) == v for (k, e), v in new.items() if k == "id_number")


def test_titles_tell_the_gender_of_given_names(spark):
    text = "Mrs. Colin Hexstead, Frau Colin Dunderby, Mr Grace Ketbrill and Colin Branstead"
    assert [p["title"] for p in pii.entities(text, NAMES)] == ["f", "f", "m", None]
    each = spark.createDataFrame([("name", p["entity"], p["title"]) for p in pii.entities(text, NAMES)], "kind string, entity string, title string")
    sexes = pii.genders(each, PARTS)
    assert sexes == {"colin": "f", "grace": "m"}
    pools = pii.make_pools(PARTS, sexes)
    assert pii.name_class(["colin", "x"], pools) == ("en", "f") and pii.name_class(["thea", "x"], pools) == ("en", "f") and pii.name_class(["jonas", "x"], pools) == ("en", "m")


def test_names_keep_their_script():
    pools = pii.make_pools(PARTS)
    for w in ("иван петров", "νικος παπας"):
        new = pii.candidate("name", w, 0, b"k", pools)
        assert new != w and [c == " " for c in new] == [c == " " for c in w] and not any(c.isascii() for c in new.replace(" ", ""))
    for attempt in range(8):
        assert pii.candidate("name", "colin hexstead", attempt, b"k", pools) not in {pii.candidate("name", "colin hexstead", a, b"k", pools) for a in range(attempt)}


def test_anchors_leave_out_nothing():
    """Numbers anywhere in long texts, with their extensions, after and before other digits."""
    for pad in ("", "x " * 50, "1 2 3 " * 20, "2025-03-01 12:00:05 "):
        for seen, kind in (("512-555-0183 extension 123456", "phone"), ("QQ 62 05 90 C", "id_number"), ("+44 (0)20 7946 0131", "phone"), ("(+44) (0)20 7946 0131", "phone"), ("931-01-8142", "id_number")):
            t = f"{pad}call {seen}, {pad}"
            assert (kind, t.index(seen), t.index(seen) + len(seen)) in pii.find_places(t, NAMES), (pad, seen)
