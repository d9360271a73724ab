"""Texts garbled on purpose come back; correct ones in many languages stay."""

import pytest

from ravelin.llm import mojibake as mj

CORRECT = [
    "Der Schlüssel für die Tür heißt „Süd 4“ – größer als 21 °C", "L’écran reste figé à l’ouverture, c’est déjà réglé…", "¿Dónde está el año señalado? Contraseña caducó",
    "A SITUAÇÃO NÃO MUDOU, NÃO é possível abrir a ligação", "Zażółć gęślą jaźń, później też działa", "Список деталей пуст уже второй день", "НЕ РАБОТАЕТ ПЕЧАТЬ", "夜間処理の停止が確認されました",
    "Size 11 × 84 µm, € 1 240,50, ½ inch, ™ and § signs", "naïve café “old” client", "Ελληνικά γράμματα εδώ", "2.º B, nº 7", "plain ASCII text & more", "why??? really?", "page?id=3&x=y http://a.b/c?d=e",
    "Our CSV shows Ã© where the web page shows é, please fix the export.", "The partner sends â€™ for each apostrophe; our screen is correct.", "every ü comes out as Ã¼, here it looks right", "한국어 문장입니다", "naïveté", "É", "ß",
]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_left(text):
    assert mj.Restorer().text(text) == (text, False, True)


def garbled(text, wrote, read):
    raw = text.encode(wrote)
    return "".join({b: c for c, b in reversed(mj.PAGES[read].items())}.get(b, chr(b)) for b in raw)


CASES = [("Der Schlüssel für die Tür ist größer", "utf-8", p) for p in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250")]
CASES += [("Список деталей пуст уже второй день", "utf-8", p) for p in ("cp1252", "cp1251", "cp437")]
CASES += [("Список деталей пуст уже второй день", "koi8-r", "cp1251"), ("Список деталей пуст уже второй день", "cp1251", "latin-1"), ("夜間処理の停止が確認されました", "cp932", "cp1252"), ("夜間処理の停止が確認されました", "utf-8", "cp1252")]


CASES += [("Το σύστημα δεν ανταποκρίνεται μετά την ενημέρωση", "cp1253", "cp1252"), ("Το σύστημα δεν ανταποκρίνεται", "iso8859-7", "latin-1"), ("המערכת אינה מגיבה לאחר העדכון", "cp1255", "cp1252"), ("Das Gerät läuft für größere Stücke", "cp850", "cp1252")]
CASES += [("系统更新后没有响应请尽快处理", "gb18030", "latin-1"), ("系统更新后没有响应请尽快处理", "gbk", "cp1252"), ("系統更新後沒有回應請盡快處理", "big5", "latin-1"), ("업데이트 후에 시스템이 응답하지 않습니다", "cp949", "latin-1")]


@pytest.mark.parametrize(("text", "wrote", "read"), CASES)
def test_garbled_text_comes_back(text, wrote, read):
    assert mj.Restorer().text(garbled(text, wrote, read)) == (text, True, True)


def test_many_times_and_cut_short(monkeypatch):
    x = "Größe"
    for _ in range(4):
        x = garbled(x, "utf-8", "latin-1")
    assert mj.Restorer().text(x) == ("Größe", True, True)
    monkeypatch.setattr(mj, "MAX_STATES", 2)
    assert mj.Restorer().text(x)[2] is False  # says that it didn't look at all


def test_twice_in_part_and_lost():
    r = mj.Restorer()
    twice = garbled(garbled("Gerät meldet ungültige Schlüssel", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert r.text(twice)[0] == "Gerät meldet ungültige Schlüssel"
    part = "Ça bloque l’équipe. " + garbled("Le rapport était déjà envoyé.", "utf-8", "cp1252")
    assert r.text(part) == ("Ça bloque l’équipe. Le rapport était déjà envoyé.", True, True)
    assert r.text("Ger�t meldet ung�ltige")[1:] == (True, False)
    assert r.text("Ger??t meldet ung??ltige")[1:] == (True, False)


JAPANESE = "夜間処理の停止が確認されました。ﾃｽﾄ環境では装置番号12の再起動後に復旧したため、記録を添付します。"
LONG = [(JAPANESE, "utf-8", "cp1252"), (JAPANESE, "utf-8", "latin-1"), (JAPANESE.replace("ﾃｽﾄ", "A"), "cp932", "cp1252"), (JAPANESE.replace("ﾃｽﾄ", "A"), "euc_jp", "latin-1"), ("проверкасвязи,отказ;", "koi8-r", "cp1251"), ('{"größe":"für","süd":1},', "utf-8", "cp437")]


@pytest.mark.parametrize(("unit", "wrote", "read"), LONG)
@pytest.mark.parametrize("shift", [0, 1, 2])
def test_long_unspaced_text_comes_back(unit, wrote, read, shift):
    text = "x" * shift + (unit * (5_000 // len(unit) + 1))[:5_000]
    assert mj.Restorer().text(garbled(text, wrote, read)) == (text, True, True)


@pytest.mark.parametrize("text", ["Ger&Atilde;&curren;t f&Atilde;&frac14;r K&Atilde;&para;ln", r"Ger\u00c3\u00a4t f\u00c3\u00bcr K\u00c3\u00b6ln"])
def test_escaped_after_it_was_garbled(text):
    assert mj.Restorer().text(text) == ("Gerät für Köln", True, True)


@pytest.mark.parametrize("text", ["Ger&auml;t f&uuml;r K&ouml;ln", r"Ger\u00e4t f\u00fcr", "a &amp; b &lt;c&gt; d&nbsp;e", "Write &Atilde;&frac14; for it", "AT&T; R&D"])
def test_escapes_alone_are_left(text):
    assert mj.Restorer().text(text) == (text, False, True)


def test_long_pieces_in_part():
    one = garbled("ü", "utf-8", "cp1252")
    for n in (997, 998, 999, 1000, 1899):
        assert mj.search_long("a" * n + one * 3 + "b" * 3000)[0] == "a" * n + "üüü" + "b" * 3000
    mixed = '{"größe":"für"},' * 100 + garbled('{"größe":"für"},' * 100, "utf-8", "cp1252") + garbled('{"größe":"für"},' * 100, "utf-8", "cp437")
    assert mj.search_long(mixed)[0] == '{"größe":"für"},' * 300
    right = (JAPANESE * 100)[:5_000]
    assert mj.Restorer().text(right) == (right, False, True)


def test_rows(spark):
    bad = garbled("Gerät für Köln", "utf-8", "cp1252")
    rows = [(1, bad, "fine"), (2, None, None), (3, "", bad), (None, bad, bad), (1, bad, "fine"), (4, "été " * 20_000, (bad + " ") * 5_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "seq long, subject string, body string, field string, restored string")
    got = sorted((str(r["seq"]), r["field"]) for r in mj.found(df).collect())
    assert got == sorted([("1", "subject"), ("1", "subject"), ("3", "body"), ("None", "subject"), ("None", "body"), ("4", "body")])
    assert {r["restored"] for r in mj.restore(df.where("seq < 4")).collect()} == {"Gerät für Köln"}
    assert mj.found(df.limit(0)).collect() == []
