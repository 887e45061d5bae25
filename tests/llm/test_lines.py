"""Line dedup by distinct-site spread against exact counting."""

from __future__ import annotations

import pytest

from lumenveil.llm import lines, queries


def slow(rows, min_sites: int = lines.MIN_SITES, min_chars: int = lines.MIN_CHARS) -> dict[int, str | None]:
    sites: dict[str, set] = {}
    first: dict[str, tuple] = {}
    for i, text, site in rows:
        for at, line in enumerate((text or "").split("\n")):
            key = line.strip(" ")
            if text is not None and len(key) >= min_chars and i is not None:
                sites.setdefault(key, set()).add(site)
                first[key] = min(first.get(key, (i, at)), (i, at))
    wide = {k for k, s in sites.items() if len(s - {None}) >= min_sites}
    gone = lambda i, at, line: line.strip(" ") in wide and first[line.strip(" ")] != (i, at)
    return {i: text if text is None or i is None else "\n".join(x for at, x in enumerate(text.split("\n")) if not gone(i, at, x)) for i, text, site in rows}


def test_around_the_threshold(spark):
    """Lines on 6 to 11 sites, and on many: every one as exact counting says."""
    rows, i = [], 0
    for n in (1, 6, 7, 8, 9, 10, 11, 60):
        for site in range(n):
            for copy in range(2 if site % 2 else 1):
                i += 1
                rows.append((i * 5 % 1009, f"own line of number {i} here\n  a line that is on {n:03d} sites \nend", f"site{site}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in lines.without_widespread(docs).collect()} == slow(rows)


def test_a_line_twice_in_its_first_document(spark):
    line = "boilerplate that is everywhere"
    rows = [(k, f"{line}\n{line}\nmore {k}", f"s{k}") for k in range(1, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.without_widespread(docs).collect()}
    assert got == slow(rows) and got[1] == f"{line}\nmore 1" and got[9] == "more 9"


def test_defined_cases(spark):
    line = "boilerplate that is everywhere"
    rows = [(k, line, f"s{k}") for k in range(1, 8)] + [(20, line, None), (21, None, "s1"), (22, "", "s2"), (None, line, "s9"), (30, "x " * 50_000 + "\n" + line, "s1")]
    docs = spark.createDataFrame([(*r, "r", "p") for r in rows] * 2, "doc_id long, text string, source string, row string, parts string")
    got = lines.without_widespread(docs, counts=True)
    assert got.columns == ["doc_id", "text", "source", "row", "parts", "n_lines", "n_removed"]
    found = got.collect()
    assert len(found) == 2 * len(rows)
    texts = {r.doc_id: r.text for r in found}
    assert texts[21] is None and texts[22] == "" and texts[None] == line
    assert {r.n_lines for r in found if r.doc_id == 21} == {0} and {r.n_lines for r in found if r.doc_id == 22} == {1}
    assert {(r.row, r.parts) for r in found} == {("r", "p")}
    assert lines.without_widespread(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_oracles(name, same_as_oracle):
    same_as_oracle(queries.queries()[name], queries.oracle_sql()[name])


def test_columns_of_the_counts_names_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", 5)], "doc_id long, text string, source string, n_lines int")
    got = lines.without_widespread(docs, counts=True)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "_n_lines", "n_removed"]
    assert tuple(got.first())[3:] == (5, 2, 0)
