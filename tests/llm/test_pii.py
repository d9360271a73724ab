"""What is found in texts, and the promises of the replacements."""

import pytest

from ravelin.llm import names, pii


class Words(set):
    holds = set.__contains__


#: What a corpus told.
TOLD = names.Lexicon(Words({"pell", "tamsin", "jörn"}), Words({"orrowick"}))

FOUND = {
    "Bitte an ottilie-p@mail.larkspur.example antworten.": {"email"}, "write to sam (at) example.org or SAM at post dot example dot com": {"email"}, "mail a.b @ post.example.com": {"email"},
    "Call me on +44 7700 900 121 after lunch, or (665) 555-0187": {"phone"}, "tel 030 23125 688, nobody else": {"phone"}, "Phone number on file is 01 99 00 40 37": {"phone"}, "new no. 803.555.0177 ext. 31": {"phone"},
    "For the check: SSN 981-71-7537.": {"id_number"}, "id on file NI number QQ 47 25 53 D": {"id_number"}, "passport no. X0009326": {"id_number"}, "CPF 000.022.370-32": {"id_number"}, "Ausweisnummer L00J17889": {"id_number"}, "ID card CZ 580 149.": {"id_number"},
    "We moved to 146 Wanpler Road, Zostopil; please update.": {"address"}, "Lieferanschrift ist Amselallee 11, 06073 Ganquel.": {"address"}, "157 bis rue des Alouettes, 00723 Steinhafen": {"address"}, "Calle del Olivo 106, 2.º B, Nethercombe": {"address"}, "at 137A Crumhan St., Ashmere X9 0QQ": {"address"},
    "Regards, Petra Orrowick": {"name"}, "As agreed with Stonverberg, Tamsin, nothing was changed": {"name"}, "agreed with T. Halvick, nothing": {"name"}, "Llame a PETRA ORROWICK, teléfono": {"name"}, "ask pell rulgileño or": {"name"}, "Herr Drestelsen called": {"name"}, "I spoke to Gonda Wexmer on the phone": {"name"},
    "Contact: Jörn von Krähbusch, +1 906-555-0151": {"name", "phone"},
}
CLEAN = [
    "Asset tag 912-44-0183 shows it best.", "Part 593.855.0538 is missing.", "Serial QX 47 25 53 D is on the label.", "Meter 0302 3125 771 counts down.", "Carton 096 42093 120 was fine.", "Order no 0174-5652-27 is one example.",
    "Queue length was 200 400 600.", "Version v3.2@beta does not help. We pinged @ops-team about it.", "Mail template quote@start is ignored.", "The path /srv/at/dot/export is full.", "Dr. Scan and Miss Print are plugin names.",
    "Route 9 in the planner is affected. Lane 14 and Lane 15 are closed.", "Harrow & Pike Logistics runs it. Kelder Foods and Vantry Rail do not.", "It began on 2024-03-05 at 10:15 on 192.0.2.44.", "Build 10.4.220.17 is on unit X. Please advise.", "It reads 21 °C, not 70 °F. Meter 3163 is off.", "お客様と担当者様へ", "Dear Customer, hello Team, Greetings, All", "", "   ",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert {x.kind for x in pii.detect(text, TOLD)} == FOUND[text]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert pii.detect(text) == [] == pii.detect(text, TOLD)


def test_replacements():
    r = pii.Redactor(b"key")
    a, b = r.redact("Regards, Petra Orrowick"), r.redact("Llame a ORROWICK, PETRA hoy")
    assert a.split("[")[1] == b.split("[")[1].split("]")[0] + "]"  # the same person
    assert a != r.redact("Regards, Petra Orrowitz") and a != pii.Redactor(b"other").redact("Regards, Petra Orrowick")
    assert "[NAME_F_" in a and "Petra" not in a
    s = pii.Redactor(b"key", "surrogate")
    out = s.redact("Herr PETER MAYBERG at +44 7700 900 121")
    assert out.startswith("Herr ") and out.split()[1].isupper() and out.endswith(tuple("0123456789")) and out.count(" ") == 7
    assert pii.surrogate(b"k", pii.Item(0, 14, "id_number"), "QQ 47 25 53 D")[2] == " "
    assert r.redact("nothing here") == "nothing here"


def test_rows(spark):
    rows = [(1, "mail a@b.example", [("x", None), ("x", "Regards, Petra Orrowick"), ("x", "tel 030 23125 688")], None), (2, None, None, "SSN 981-71-7537"), (3, "", [], ""), (None, "a@b.example", None, None), (1, "mail a@b.example", None, "x" * 200_000)]
    df = spark.createDataFrame([(s, b, c, r, "q", 7) for s, b, c, r in rows], "seq long, body string, comments array<struct<author:string,text:string>>, resolution string, field string, pos int")
    got = sorted((str(r["seq"]), r["field"], r["pos"], r["kind"]) for r in pii.found(df).collect())
    assert got == sorted([("1", "body", 0, "email"), ("1", "comments", 2, "name"), ("1", "comments", 3, "phone"), ("2", "resolution", 0, "id_number"), ("None", "body", 0, "email"), ("1", "body", 0, "email")])
    assert pii.found(df.limit(0)).collect() == []
    table = pii.surrogate_table(df, "k").collect()
    assert len(table) == len({(r["kind"], r["surrogate"].lower()) for r in table}) == 5  # of the name each word


def test_colliding_surrogates_draw_again(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i}@b.example", None, None) for i in range(12)], "seq long, body string, comments array<struct<author:string,text:string>>, resolution string")
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda key, item, text, turn=0: "same@example.org" if turn == 0 else real(key, item, text, turn))
    table = pii.surrogate_table(df, "k").collect()
    assert len(table) == 12 == len({r["surrogate"] for r in table})


def test_surrogates_in_texts_are_those_of_the_table(spark):
    people = [g.capitalize() for g, x in pii.GIVEN.items() if x == "f" and g.isascii()]
    bodies = [f"Regards, {g}" for g in people] + [f"Thanks, {people[0]}", "Regards, Petra K. Orrowick", "Llame a ORROWICK, PETRA hoy", "tel +44 7700 900 121", "tel 0044 7700 900121"]
    df = spark.createDataFrame([(i, b, None, None) for i, b in enumerate(bodies)], "seq long, body string, comments array<struct<author:string,text:string>>, resolution string")
    table = {r["entity"]: r["surrogate"].lower() for r in pii.surrogate_table(df, "k").where("kind = 'name'").collect()}
    rows = pii.redacted(df, "k", how="surrogate").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(bodies)))
    out = [r["redacted"] for r in rows]
    n = len(people)
    lone = [t.removeprefix("Regards, ").lower() for t in out[:n]]
    assert lone == [table[g.lower()] for g in people] and len(set(lone)) == n  # hardly any draw without a collision
    assert out[n].lower() == f"thanks, {lone[0]}"
    assert pii.canonical("name", out[n + 1].removeprefix("Regards, ")) == pii.canonical("name", out[n + 2].removeprefix("Llame a ").removesuffix(" hoy"))
    assert pii.canonical("phone", out[n + 3].removeprefix("tel ")) == pii.canonical("phone", out[n + 4].removeprefix("tel "))


def test_surrogates_keep_the_script_and_small_spaces_widen():
    for name, script in (("Иван Петров", "CYRILLIC"), ("Νίκος Παππάς", "GREEK"), ("田中", "CJK"), ("Petra Orrowick", "LATIN")):
        out = pii.surrogate(b"k", pii.Item(0, len(name), "name"), name, 1)
        assert out != name and all(script in pii.unicodedata.name(c) for c in out if c.isalpha())
    item = pii.Item(0, 2, "id_number")
    assert len({pii.surrogate(b"k", item, "12", t) for t in range(16)}) > 12


#: Given names and surnames that no list of the library holds.
UNHEARD = [("Bartholomew", "Quince"), ("Chidi", "Okonkwo"), ("Bogdan", "Wisła"), ("Thandiwe", "Mbeki"), ("Eluned", "Gwyther"), ("Дмитрий", "Соколов"), ("Надежда", "Орлова"), ("Radomir", "Kostić"), ("Solveig", "Aasen"), ("Ngozi", "Adeyemi")]
USES = ["{g} {s} says it is slow.", "the printer of {g} {s} is off", "{S}, {g} was told", "ASK {G} {S} AGAIN", "then {g} left"]


def test_unheard_names_are_learned(spark):
    """Names held out from the list: introduced twice in the corpus, then used without any introduction."""
    texts = [t for g, s in UNHEARD for t in (f"Nothing works. Regards, {g} {s}", f"We spoke to {g} {s} about it.", f"Dear {g}, it is done")]
    used = [(g, u.format(g=g, s=s, S=s, G=g.upper()) if "ASK" not in u else f"ASK {g.upper()} {s.upper()} AGAIN") for g, s in UNHEARD for u in USES]
    assert not set(pii.GIVEN) & {g.lower() for g, _ in UNHEARD}
    rows = [(i, t, None, None) for i, t in enumerate([*texts, *[t for _, t in used], "Bring 田中太郎さん the key", "Ask 王小明先生"])]
    df = spark.createDataFrame(rows, "seq long, body string, comments array<struct<author:string,text:string>>, resolution string")
    found = {r["seq"] for r in pii.found(df).where("kind = 'name'").collect()}
    assert found >= set(range(len(texts)))
    late = [len(texts) + i in found for i in range(len(used) + 2)]
    assert sum(late) >= 0.9 * len(late) and all(late[-2:])
    assert not any(pii.detect(t) for _, t in used)


def test_one_person_in_several_ways():
    r = pii.Redactor(b"key", "surrogate")
    a, b, c = r.redact("Regards, Anna Braun"), r.redact("Ms Braun called"), r.redact("BRAUN, ANNA called")
    given, surname = a.removeprefix("Regards, ").split()
    assert b == f"Ms {surname} called" and c == f"{surname.upper()}, {given.upper()} called" and "Braun" not in a
    assert r.redact("Regards, A. Braun") == f"Regards, {surname[0]}. {surname}"
