from collections import defaultdict

import pytest

from ledgerline.llm import line_spread as ls
from ledgerline.llm.line_spread import remove_boilerplate

WHITE = "\t\n\x0b\x0c\r "


def brute(rows, sites, words):
    def key(line):
        body = line.strip(WHITE)
        return body if len(body.split()) >= words else None

    seen, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if (k := key(line)) is not None:
                if site is not None:
                    seen[k].add(site)
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    bad = {k for k, s in seen.items() if len(s) >= sites}
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if key(x) not in bad or first.get(key(x)) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def answer(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("listed", [ls.LISTED, 0])
def test_against_brute_force(spark, docs, monkeypatch, listed):
    monkeypatch.setattr(ls, "LISTED", listed)  # with none listed, lines meet documents by a join
    rows = []
    for i in range(60):
        text = f"own line of number {i} here\nshared by all the sites {i % 3}\n  spread over few sites {i % 20}  \nshort one\n"
        rows.append((i, text, f"s{i % 9}"))
    rows += [(5, "shared by all the sites 0", None), (None, "shared by all the sites 0\nx", "s1"), (70, None, "s1"), (71, "", "s2"), (72, "a\n\n b", None), (3, rows[3][1], "s3")]
    ends = ["", " ", "\t", "\r", " \x0b ", "\x0c\t"]
    rows += [(200 + i, f"{ends[i % 6]}odd  ends\tof every line{ends[(i + 2) % 6]}\nonly\r\nfour short word s", f"s{i}") for i in range(8)]
    rows += [(None, "of rows without an id only", f"s{i}") for i in range(5)] + [(300, "x" * 100_000, "s1"), (301, " " * 50_000 + "\n" + "a b c d " * 9000, "s1")]
    out = remove_boilerplate(docs([(*r, 7, "row") for r in rows], "doc_id long, text string, source string, n_lines int, key string"), least_sites=4, least_words=4)
    assert set(out.columns) == {"doc_id", "text", "source", "key", "n_lines", "n_removed"}
    assert answer(out) == sorted(brute(rows, 4, 4), key=str)


def test_exact_counts_near_the_threshold(spark, docs):
    rows = [(100 * n + i, f"a line of {n} sites exactly", f"site{i}") for n in (38, 39, 40, 41, 42) for i in range(n)]
    got = remove_boilerplate(docs(rows, "doc_id long, text string, source string"), least_sites=40, least_words=3).where("n_removed > 0")
    assert {r["doc_id"] // 100 for r in got.collect()} == {40, 41, 42}


def test_empty_table(spark, docs):
    assert remove_boilerplate(docs([], "doc_id long, text string, source string")).collect() == []
