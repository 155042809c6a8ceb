import datetime
import random
import re

import pytest

from ledgerline.llm.pseudonyms import FIRST_YEAR, LAST_YEAR, Permutation, luhn_digit, pseudonymize, replaced

P = Permutation(b"key")


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_permutation_is_one_to_one(size):
    image = [P.apply("k", v, size) for v in range(size)]
    assert sorted(image) == list(range(size))
    assert [P.invert("k", v, size) for v in image] == list(range(size))


def test_formats_stay_valid():
    body = "411111111111111"
    card = body + luhn_digit(body)
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    text = f"pay {card} or {spaced}; born 1999-12-31, 31/12/1999 and 31.12.1999; call +1 (555) 123-4567, ip 10.20.30.40, ssn 123-45-6789, iban GB82WEST DE89370400440532013000."
    out, n = replaced(P, text)
    assert (n["card"], n["date"], n["phone"], n["ip"], n["ssn"], n["iban"]) == (2, 3, 1, 1, 1, 1)
    cards = re.findall(r"\b\d{16}\b|\d{4} \d{4} \d{4} \d{4}", out)
    plain = [c.replace(" ", "") for c in cards]
    assert plain[0] == plain[1] != card and luhn_digit(plain[0][:-1]) == plain[0][-1] and " " in cards[1]
    iso = re.search(r"\d{4}-\d{2}-\d{2}", out).group()
    day = datetime.date.fromisoformat(iso)
    assert day.strftime("%d/%m/%Y") in out and day.strftime("%d.%m.%Y") in out and FIRST_YEAR <= day.year <= LAST_YEAR
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4},", out)
    iban = re.search(r"DE\d{20}", out).group()
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert not set(re.findall(r"\d{5,}", text)) & set(re.findall(r"\d{5,}", out))


def test_invalid_values_stay():
    text = "2023-02-30 999.1.1.1 DE00370400440532013000x 1234 version 1.2.3.4.5 12-34"
    assert replaced(P, text)[0] == text


def test_links_and_keys():
    a, b = replaced(P, "a 9807915762804490 b")[0], replaced(P, "9807915762804490")[0]
    assert a == f"a {b} b"
    assert replaced(Permutation(b"other"), "9807915762804490")[0] != b


def test_table(spark, docs):
    rows = [(1, "x 10.0.0.1", 4), (1, "x 10.0.0.1", 4), (2, None, 4), (None, "", 4), (3, "10.0.0.1 " * 20000, 4)]
    out = pseudonymize(docs(rows, "doc_id long, text string, n_ip int"), b"k").collect()
    assert len(out) == 5
    assert {(r["doc_id"], r["n_ip"]) for r in out} == {(1, 1), (2, 0), (None, 0), (3, 20000)}
    assert [r["text"] for r in out if r["doc_id"] == 2] == [None]
    assert pseudonymize(docs([]), b"k").collect() == []


def test_card_beside_other_numbers():
    card = "4111111111111111"
    new = replaced(P, card)[0]
    for text in ("{} 12/25", "{} 123 Main St", "pay {} 42, then", "No 12 {} ok", "{} 2023-02-30", "{}-12", "2024 {} 7"):
        out, n = replaced(P, text.format(card))
        assert (out, n["card"], n["number"]) == (text.format(new), 1, 0), text
    spaced, grouped = "4111 1111 1111 1111", " ".join(new[i : i + 4] for i in range(0, 16, 4))
    for text in ("{} 123 Main", "2024 {}", "5 {} 12/25"):
        assert replaced(P, text.format(spaced))[0] == text.format(grouped), text
    # Values after the card are still found, and a plain number keeps its link beside another.
    out, n = replaced(P, f"{card} 12 {card} 10.0.0.1")
    assert (out.split()[:3], n["card"], n["ip"]) == ([new, "12", new], 2, 1)
    plain = "1234567890123456"
    assert replaced(P, f"{plain} 12/25")[0] == f"{replaced(P, plain)[0]} 12/25"


def test_ibans_with_letters():
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606", "IT60 X054 2811 1010 0000 0123 456", "DE89 3704 0044 0532 0130 00"]
    for spaced in ibans:
        joined = spaced.replace(" ", "")
        a, n = replaced(P, f"to {joined}, now")
        new = a[3:-5]
        assert n["iban"] == 1 and sum(n.values()) == 1 and new != joined and new[:2] == joined[:2]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in joined]
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        for text in ("{}", "{} PAID NOW", "{} 2024"):
            out, n = replaced(P, text.format(spaced))
            assert n["iban"] == 1 and out[: len(spaced)].replace(" ", "") == new and out[len(spaced) :] == text[2:], text
    # What looks like an IBAN hides no value that follows.
    assert replaced(P, "ID12 ABCD 4111 1111 1111 1111")[1]["card"] == 1


def test_values_behind_marks_and_other_formats():
    card = "4111111111111111"
    for before in ("card-", "no.", "x: ", "(", "-"):
        assert replaced(P, f"{before}{card}")[0] == before + replaced(P, card)[0]
    out, n = replaced(P, "born 12/31/1999, call 555-123-4567 or (555) 123-4567")
    assert n["date"] == 1 and n["phone"] == 2
    assert re.fullmatch(r"born (0\d|1[0-2])/\d\d/\d{4}, call \d{3}-\d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}", out)
    iso = datetime.date.fromisoformat(replaced(P, "1999-12-31")[0])
    assert iso.strftime("%m/%d/%Y") in out
    assert "".join(re.findall(r"\d", out.split(" or ")[0][-12:])) == "".join(re.findall(r"\d", out.split(" or ")[1]))
    assert replaced(P, "1.2.3.4.5 and 7-555-123-4567")[1]["phone"] == 0


def test_mail_and_hexadecimal():
    out, n = replaced(P, 'Und.34@mail7.example.com, "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" or UND.34@x.org; deadbeefdeadbeefdeadbeefdead 123@ a@b')
    assert (n["mail"], n["hex"]) == (2, 1) and out.endswith("; deadbeefdeadbeefdeadbeefdead 123@ a@b")
    a, b = re.findall(r"([A-Za-z]{3}\.\d\d)@", out)
    assert a != "Und.34" and a.lower() == b.lower() and b.isupper() and a[0].isupper()
    hexed = re.search(r'"([0-9a-f]{40})"', out).group(1)
    assert hexed in replaced(P, "x b44e15e09fd311c3cf3163b66d5a9875b883d8ce")[0] and "b44e" not in out
    long = "0a" * 64
    assert re.fullmatch(r"[0-9a-f]{128}", replaced(P, long)[0]) and replaced(P, long)[0] != long


def plain(kind, value):
    """The pseudonym of one value, told from the permutation alone."""
    if kind == "date":
        first = datetime.date(FIRST_YEAR, 1, 1).toordinal()
        days = datetime.date(LAST_YEAR, 12, 31).toordinal() - first + 1
        return datetime.date.fromordinal(first + P.apply("date", datetime.date.fromisoformat(value).toordinal() - first, days)).isoformat()
    if kind == "ip":
        new = P.apply("ip", sum(int(x) << 8 * (3 - i) for i, x in enumerate(value.split("."))), 1 << 32)
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    digits = value.replace("-", "")
    if kind == "ssn":
        new = f"{P.apply('ssn', int(digits), 10**9):09}"
        return f"{new[:3]}-{new[3:5]}-{new[5:]}"
    if kind == "card":
        new = f"{P.apply('card', int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}}"
        return new + luhn_digit(new)
    return f"{P.apply('number', int(digits), 10 ** len(digits)):0{len(digits)}}"


def test_table_against_plain_values(spark, docs):
    r = random.Random(6)
    rows, want = [], []
    for i in range(300):
        words, new, counts = [], [], {}
        for _ in range(r.randint(0, 40)):
            kind = r.choice(["word"] * 8 + ["date", "ip", "ssn", "card", "number"])
            if kind == "word":
                x = y = r.choice(["a", "la", "über", "3.", "v2", "12", "50%", "é,"])
            else:
                body = "".join(r.choice("0123456789") for _ in range(r.randint(12, 18)))
                x = {
                    "date": f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                    "ip": ".".join(str(r.randint(0, 255)) for _ in range(4)),
                    "ssn": f"{r.randint(0, 999):03}-{r.randint(0, 99):02}-{r.randint(0, 9999):04}",
                    "card": body + luhn_digit(body),
                    "number": body + str((int(luhn_digit(body)) + 1) % 10),
                }[kind]
                y = plain(kind, x)
                counts[kind] = counts.get(kind, 0) + 1
            words.append(x)
            new.append(y)
        # Values stand apart, as neighbours of digits would be read together.
        rows.append((i, " | ".join(words)))
        want.append((i, " | ".join(new), *[counts.get(k, 0) for k in ("date", "ip", "ssn", "card", "number")]))
    got = pseudonymize(docs(rows), b"key").select("doc_id", "text", "n_date", "n_ip", "n_ssn", "n_card", "n_number")
    assert sorted(map(tuple, got.collect())) == want
