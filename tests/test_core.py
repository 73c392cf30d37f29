"""Chunks, search, sync, snapshots, pages, files and commands on small hand-made fixtures."""

import hashlib
import io
import itertools
import json
import os
import random
import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.catalog import Catalog, CatalogError
from siltstone.functions import text
from siltstone.operators import chunks, index, snapshots, sync
from siltstone.plans import groups, terms
from siltstone.plans import search as search_plans
from siltstone.plans.search import search
from siltstone.sources import extract, scan
from siltstone.sources.settings import Settings, SettingsError


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 가é\n\r\t ", max_size=80), st.integers(1, 20))
def test_chunks_give_the_text_again(text, budget):
    parts = chunks.pieces(text, budget)
    assert "".join(parts) == text and all(parts)
    for p in parts:
        assert len(p.encode()) <= budget or len(p.split()) <= 1


def test_long_word_stays_whole_and_path_is_on_first_chunk():
    assert chunks.pieces("a" * 34, 8) == ["a" * 34]
    assert "".join(chunks.pieces("가나다라마바사", 1)) == "가나다라마바사"


def catalog_of(spark, files, budget=32768):
    entries = spark.createDataFrame([(i, p, f"/root/{p}", s) for i, (p, c, s) in enumerate(files, 1)], "id bigint, relative_path string, absolute_path string, status string")
    rows, n = [], 0
    for i, (p, c, s) in enumerate(files, 1):
        for k, part in enumerate(chunks.pieces(c or "", budget) or [""]):
            n += 1
            rows.append((n, i, k, p if k == 0 else "", part, None))
    parts = spark.createDataFrame(rows, "id bigint, entry_id bigint, chunk_index int, relative_path string, content string, ngrams string")
    return chunks.with_ngrams(parts), entries


def found(spark, files, question, limit=5, budget=32768):
    parts, entries = catalog_of(spark, files, budget)
    asked = spark.createDataFrame([(1, question)], "query_id bigint, query_text string")
    return [r.relative_path for r in search(asked, parts, entries, limit).orderBy("rank").collect()]


def test_glued_and_spaced_words_meet(spark):
    assert found(spark, [("a.md", "이것은 온도보정알고리즘이 맞다", "extracted")], "온도 보정 알고리즘") == ["a.md"]
    assert found(spark, [("a.md", "온도 보정 알고리즘", "extracted")], "온도보정알고리즘") == ["a.md"]
    assert found(spark, [("a.md", "아무 상관 없는 글", "extracted")], "온도보정알고리즘") == []


def test_words_in_different_files_then_in_one(spark):
    files = [("a.md", "온도 기록", "extracted"), ("b.md", "펌프 기록", "extracted")]
    assert set(found(spark, files, "온도 펌프")) == {"a.md", "b.md"}
    assert found(spark, [*files, ("c.md", "온도 와 펌프", "extracted")], "온도 펌프") == ["c.md"]


def test_name_beats_body_and_unread_files_come_last(spark):
    filler = [(f"x{i}.md", "다른 글 입니다", "extracted") for i in range(6)]
    assert found(spark, [("body.md", "온도센서점검 기록", "extracted"), ("온도센서점검.md", "기록", "extracted"), *filler], "온도센서점검")[0] == "온도센서점검.md"
    got = found(spark, [("fresh-report.txt", "보고서 내용", "extracted"), ("legacy-보고서.ppt", "", "error"), *filler], "보고서")
    assert got == ["fresh-report.txt", "legacy-보고서.ppt"]


def test_across_chunks_and_phrases_and_limits(spark):
    files = [("one.md", "red blue", "extracted"), ("far.md", "red xxxxxxxx blue", "extracted"), ("none.md", "green words", "extracted")]
    assert found(spark, files, "red blue", budget=16) == ["one.md", "far.md"]
    assert found(spark, files, "red blue", limit=0) == []
    cars = [("a.md", "the mercedes benz car", "extracted"), ("b.md", "the benz mercedes car", "extracted"), ("c.md", "nothing else", "extracted")]
    assert found(spark, cars, "Mercedes-Benz") == ["a.md"]
    assert found(spark, [("route-map.bin", "", "unsupported"), *files], "route map") == ["route-map.bin"]
    assert found(spark, files, "what is the") == []


def test_null_questions_and_empty_tables(spark):
    parts, entries = catalog_of(spark, [("a.md", "red", "extracted")])
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "red")], "query_id bigint, query_text string")
    assert [r.query_id for r in search(asked, parts, entries).collect()] == [3]
    assert search(asked.limit(0), parts, entries).count() == 0
    assert search(asked, parts.limit(0), entries).count() == 0


def group_case(spark, monkeypatch):
    """Dealt scores and questions, their rows {(word, chunk): (entry, index, weighted, plain)}, and the words of each question."""
    for name, most in (("MOST_ROWS", 40), ("LEAST_ROWS", 10), ("BLOCK", 5)):
        monkeypatch.setattr(groups, name, most)
    r, rows = random.Random(3), {}
    for entry in range(14):
        for index in range(r.randint(1, 4)):
            # ids against the order of the chunks, few different scores: ties are settled by the place in the file
            rows |= {(w, 1000 * (9 - index) + entry): (entry, index, r.choice([1.0, 2.0, 2.5]), r.choice([1.0, 1.5])) for w in range(9) if r.random() < 0.3}
    questions = {q: r.sample([*range(9), 50, 51, 52], r.randint(1, 8)) for q in range(40)} | {40: [50, 51], 41: [0], 42: [0], 43: [50, 3, 51]}
    rows[60, 1] = (1, 8, 1.0, 1.0)
    rows[61, 2] = (2, 8, 1.0, 1.0)
    questions[44] = [60, 61]  # never in one file: any word will do
    scores = spark.createDataFrame([(w, c, i, e, x, p) for (w, c), (e, i, x, p) in rows.items()], "word bigint, chunk_id bigint, chunk_index int, entry_id bigint, weighted double, plain double")
    asked = spark.createDataFrame([(q, len(ws), k, w, str(w)) for q, ws in questions.items() for k, w in enumerate(ws)], "query_id bigint, n_clauses int, clause int, word bigint, token string")
    return asked, groups.dealt(scores), rows, questions


def group_of(words, rows):
    for size in range(len(words), 0 if len(words) == 1 else 1, -1):
        for g in itertools.combinations(range(len(words)), size):
            if set.intersection(*[{e for (w, _), (e, *_) in rows.items() if w == words[k]} for k in g]):
                return g


def test_chosen_groups_and_same_chunk_equal_brute_force(spark, monkeypatch):
    asked, scores, rows, questions = group_case(spark, monkeypatch)
    assert scores.rdd.getNumPartitions() > 2
    chosen = search_plans.chosen_groups(asked, scores)
    want = {q: g for q, ws in questions.items() if (g := group_of(ws, rows))}
    assert {r.query_id: (r.mask, r["size"], r["first"]) for r in chosen.collect()} == {q: (sum(1 << k for k in g), len(g), g[0]) for q, g in want.items()}
    best = {}
    for q, ws in questions.items():
        g = [ws[k] for k in want.get(q, range(len(ws)))]
        for c in {c for _, c in rows}:
            held = [rows[w, c] for w in g if (w, c) in rows]
            if held and (q not in want or len(held) == len(g)):
                key = (-sum(h[2] for h in held), held[0][1], c)
                best[q, held[0][0]] = min(best.get((q, held[0][0]), key), key)
    got = {(r.query_id, r.entry_id): (-r.score, r.chunk_id) for r in search_plans.same_chunk(asked, scores, chosen).collect()}
    assert got == {k: (s, c) for k, (s, _, c) in best.items()} and len(got) > 60


def test_across_chunks_equals_brute_force(spark, monkeypatch):
    asked, scores, rows, questions = group_case(spark, monkeypatch)
    want = {}
    for q, ws in questions.items():
        g = [ws[k] for k in group_of(ws, rows) or ()]
        for e in range(14):
            held = [[(-p, i, c) for (w, c), (entry, i, _, p) in rows.items() if w == word and entry == e] for word in g]
            if len(g) > 1 and all(held):
                want[q, e] = (sum(min(h)[0] for h in held), min(held[0])[2])
    got = {(r.query_id, r.entry_id): (-r.score, r.chunk_id) for r in search_plans.across_chunks(asked, scores, search_plans.chosen_groups(asked, scores)).collect()}
    assert got == want and len(got) > 30


def test_files_without_an_entry_take_no_place(spark):
    parts, entries = catalog_of(spark, [("a.md", "red blue", "extracted"), ("far.md", "red xxxxxxxx blue", "extracted"), ("other.md", "green", "extracted")], 16)
    asked = spark.createDataFrame([(1, "red blue")], "query_id bigint, query_text string")
    assert [r.relative_path for r in search(asked, parts, entries.where("relative_path <> 'a.md'"), 1).collect()] == ["far.md"]


def test_the_first_files_are_the_first_of_all_with_few_demoted_and_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(groups, "LEAST_ROWS", 5)
    files = [(f"{i:02d}.md", "red blue " + "x " * (i // 10), "error" if i < 10 else "extracted") for i in range(40)] + [(f"far{i}.md", "red xxxxxxxx yyyyyyyy blue", "extracted") for i in range(3)]
    order = [f"{i:02d}.md" for i in [*range(10, 40), *range(10)]] + [f"far{i}.md" for i in range(3)]
    for limit in (1, 12, 33, 42):
        assert found(spark, files, "red blue", limit, 20) == order[:limit]


def test_scores_straight_from_chunks_equal_those_of_postings(spark, monkeypatch):
    monkeypatch.setattr(groups, "LEAST_ROWS", 5)
    texts = ["red-blue red blue Red", "blue red", "온도보정 알고리즘 온도 보정", "온도보정알고리즘 red", "", None, "rėd blue red-blue-green", "green blue", "알고리즘 온도온도"]
    parts, _ = catalog_of(spark, [(f"blue/red-{i}.md", t, "extracted") for i, t in enumerate(texts * 3)], 16)
    asked = search_plans.clauses(spark.createDataFrame(enumerate(["red-blue green", "blue red", "온도보정알고리즘 Red", "온도온도온도", "nowhere", "red-blue-green RED"]), "query_id bigint, query_text string"))
    rows = lambda df: sorted((r.word, r.chunk_id, r.chunk_index, r.entry_id, round(r.weighted, 9), round(r.plain, 9)) for r in groups.flat(df).collect())
    got = search_plans.chunk_scores(asked, parts.union(parts))  # repeated rows count once
    assert got.rdd.getNumPartitions() > 2 and got.count() <= parts.count()
    assert rows(got) == rows(search_plans.word_scores(asked, parts)) and len(rows(got)) > 80


def test_asked_terms_of_texts_are_those_of_the_index(spark, monkeypatch):
    r = random.Random(1)
    signs = [*"abZİßΣςéǢǰñÅﬀ온도한가1² -_.\n\r\x00", "e\u0301", "\u0301", "\u036f", "\u0370", "\ue000", "\ud7ff", "\U0001d400", "\U0001f600", "\U000f0000"]
    texts = ["", "\u0301", "a\u0301b", *("".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(600))]
    rows = spark.createDataFrame(enumerate(texts), "i int, x string").select("i", F.lower("x").alias("small"), text.index_tokens(F.col("x")).alias("terms")).orderBy("i").collect()
    asked = [*sorted({t for row in rows for t in row.terms})[::3], "nowhere"]
    for most in (terms.SLICE, 50):
        monkeypatch.setattr(terms, "SLICE", most)
        counts, got = [], []
        for first, n, at, pos, code in terms.Terms(asked, terms.letters(spark)).standing([row.small for row in rows]):
            assert first == len(counts)
            counts += n.tolist()
            got += zip((at + first).tolist(), pos.tolist(), [asked[c] for c in code.tolist()])
        assert counts == [len(row.terms) for row in rows]
        assert got == [(row.i, k, t) for row in rows for k, t in enumerate(row.terms) if t in set(asked)] and len(got) > 100


def test_old_chunks_have_their_pairs_and_count_once_with_filled_ones(spark, monkeypatch):
    r = random.Random(2)
    texts = ["", "온", "온도", *("".join(r.choice("온도보정漢字ㄱ가aB \nİ") for _ in range(r.randint(0, 30))) for _ in range(60))]
    old = chunks.chunked(spark.createDataFrame(enumerate(texts), "id bigint, text string"), "id", "text", 32).select(F.expr("entry_id * 100 + chunk_index").alias("id"), "entry_id", "chunk_index", F.when(F.col("chunk_index") == 0, F.concat(F.lit("한글보정/Ab"), "entry_id")).alias("relative_path"), "content", F.lit(None).cast("string").alias("ngrams"))
    filled = chunks.with_ngrams(old)
    rows = filled.orderBy("id").collect()
    assert terms.pairs([row.content.lower() for row in rows], [(row.relative_path or "").lower() for row in rows]) == [row.ngrams for row in rows] and terms.pairs([], []) == []
    asked = search_plans.clauses(spark.createDataFrame([(1, "온도보정"), (2, "漢字 가"), (3, "한글보정 정온")], "query_id bigint, query_text string"))
    scores = lambda df: sorted((x.word, x.chunk_id, round(x.weighted, 9), round(x.plain, 9)) for x in groups.flat(df).collect())
    want = scores(search_plans.word_scores(asked, filled))
    assert scores(search_plans.chunk_scores(asked, old)) == want and scores(search_plans.chunk_scores(asked, old.union(filled))) == want
    assert scores(search_plans.word_scores(asked, old)) == want and len(want) > 60


@pytest.mark.parametrize("cells", [1, 40, 500_000])
def test_many_lists_at_once_equal_each_by_itself(monkeypatch, cells):
    monkeypatch.setattr(groups, "CELLS", cells)
    r = random.Random(5)
    chunks_of = [(entry, k, 1000 * (9 - k) + entry) for entry in range(150) for k in range(r.randint(1, 3))]
    r.shuffle(chunks_of)
    held = {c: {w: (r.choice([1.0, 2.0, 2.5]), r.choice([1.0, 1.5])) for w in range(12) if r.random() < 0.3} for c in chunks_of}
    rows = [{"entry_id": e, "chunk_index": k, "chunk_id": c, "demoted": e % 3 == 0, "word": list(ws), "weighted": [x for x, _ in ws.values()], "plain": [x for _, x in ws.values()]} for (e, k, c), ws in held.items() if ws]
    kinds = {"entry_id": pa.int64(), "chunk_index": pa.int32(), "chunk_id": pa.int64(), "demoted": pa.int8(), "word": pa.list_(pa.int64()), "weighted": pa.list_(pa.float64()), "plain": pa.list_(pa.float64())}
    part = groups.Part(pa.Table.from_pylist([row | {"demoted": int(row["demoted"])} for row in rows], pa.schema(list(kinds.items()))))
    lists = [r.sample([*range(12), 77], r.randint(1, 8)) for _ in range(300)]
    whole = [r.random() < 0.8 for _ in lists]

    def answers(words, all_of_them, limit):
        same, across = {}, {}
        for (e, k, c), ws in held.items():
            own = [ws[w][0] for w in words if w in ws]
            if own and (not all_of_them or len(own) == len(words)):
                same[e] = min(same.get(e, (0.0, 9)), (-sum(own), k))
        for e in {e for e, _, _ in held} - set(same) if all_of_them and len(words) > 1 else ():
            best = [[(-ws[w][1], k) for (f, k, _), ws in held.items() if f == e and w in ws] for w in words]
            if all(best):
                across[e] = (sum(min(b)[0] for b in best), min(best[0])[1])
        every = sorted((stage, int(e % 3 == 0), s, k, e) for stage, found in enumerate((same, across)) for e, (s, k) in found.items())
        return {x for x in every if limit and x[:3] <= every[min(limit, len(every)) - 1][:3]}

    entry, chunk = (part.ids.column(c).to_pylist() for c in ("entry_id", "chunk_id"))
    for limit in (0, 1, 10, 1000):
        got = [set() for _ in lists]
        for own, of, at, score, stage in part.best_of_both(lists, whole, limit):
            for k, row, s, g in zip(own[of].tolist(), part.row[at].tolist(), score.tolist(), stage.tolist()):
                got[k].add((g // 2, g % 2, -s, 9 - chunk[row] // 1000, entry[row]))
        assert got == [answers(words, w, limit) for words, w in zip(lists, whole)]
    files = [[set().union(*[ws for (f, _, _), ws in held.items() if f == e])] for e in range(150)]
    first = [next((k for k, g in enumerate(groups.tried(len(words))) if any({words[i] for i in g} <= f for (f,) in files)), -1) for words in lists]
    assert part.first_groups(lists).tolist() == first


def test_search_counts_repeated_chunks_once_with_and_without_postings(spark, monkeypatch):
    files = [(f"{i}.md", "red blue " + "x " * i, "error" if i % 3 == 0 else "extracted") for i in range(12)] + [("far.md", "red xxxxxxxx yyyyyyyy blue", "extracted")]
    parts, entries = catalog_of(spark, files, 20)
    asked = spark.createDataFrame([(1, "red blue"), (2, "red blue"), (3, "yyyyyyyy")], "query_id bigint, query_text string")
    answers = lambda chunk: sorted((r.query_id, r["rank"], r.stage, r.relative_path, r.excerpt, round(r.score, 9)) for r in search(asked, chunk, entries, 13).collect())
    want = answers(parts)
    assert len(want) == 27 and answers(parts.union(parts)) == want
    files = sorted((r.query_id, r["rank"], r.stage, r.relative_path, round(r.score, 9)) for r in search_plans.ranked_files(asked, parts.union(parts), entries, 13).collect())
    assert files == [(*x[:4], x[5]) for x in want]
    monkeypatch.setattr(search_plans, "MOST_TERMS", 0)
    assert answers(parts.union(parts)) == want


ENTRY = "id bigint, relative_path string, kind string, size bigint, mtime_ns bigint, status string, extractor string, error string, sha256 string"


def test_sync_diff_settle_and_upsert(spark):
    old = spark.createDataFrame(
        [(1, "keep", "file", 1, 1, "extracted", "t", "", "s"), (2, "change", "file", 1, 1, "extracted", "t", "", "s"), (3, "gone", "file", 1, 1, "extracted", "t", "", "s"), (4, "fails", "file", 1, None, "error", "", "e", "")], ENTRY
    )
    new = spark.createDataFrame(
        [(0, "keep", "file", 1, 1, "extracted", "t", "", "s"), (0, "change", "file", 2, 1, "extracted", "t", "", "z"), (0, "new", "file", 1, 1, "extracted", "t", "", "n"), (0, "fails", "file", 1, None, "error", "", "e", ""), (0, "also", "file", 1, 1, "extracted", "t", "", "n")], ENTRY
    )
    changes = sync.diff(new, old, ("error",))
    assert {r.relative_path: r.change for r in changes.collect()} == {"keep": "unchanged", "change": "updated", "gone": "removed", "fails": "retry", "new": "added", "also": "added"}
    settled = sync.settled(changes, new, old)
    assert sync.summary(settled).first().asDict() == {"added": 2, "updated": 1, "unchanged": 2, "removed": 1}
    assert {r.relative_path: r.id for r in sync.upserted(old, new, settled).collect()} == {"keep": 1, "change": 2, "fails": 4, "also": 5, "new": 6}
    assert sync.summary(sync.diff(new.limit(0), old.limit(0))).first().added == 0


def snapshot_changes(spark, rows):
    df = spark.createDataFrame(rows, "no int, path string, at int, sha string, mtime bigint, key string, _key string")
    got = snapshots.changes(df, "no", snapshots.canonical_path(F.col("path")), "at", ["sha", "mtime"]).collect()
    return {(r.snapshot_no, r.key): (r.change_type, list(r.changed_fields)) for r in got}


def test_snapshots(spark):
    rows = [
        (1, "a", 1, "x", 1, "", ""), (1, "b", 1, "x", None, "", ""), (1, "café\\d", 1, "x", 1, "", ""), (1, "late", 1, "old", 1, "", ""), (1, "late", 9, "new", 1, "", ""), (1, None, 1, "x", 1, "", ""), (None, "z", 1, "x", 1, "", ""),
        (4, "a", 2, "x", 1, "", ""), (4, "a", 2, "x", 1, "", ""), (4, "b", 2, "x", 5, "", ""), (4, "café/d", 2, "y", 2, "", ""), (4, "late", 2, "new", 1, "", ""), (4, "n", None, None, None, "", ""),
        (9, "b", 3, "x", 5, "", ""), (9, "n", 3, None, None, "", ""), (9, "late", 3, "new", 1, "", ""), (9, "café/d", 3, "y", 2, "", ""),
    ]
    assert snapshot_changes(spark, rows) == {(4, "b"): ("changed", ["mtime"]), (4, "café/d"): ("changed", ["sha", "mtime"]), (4, "n"): ("added", []), (9, "a"): ("removed", [])}
    assert snapshot_changes(spark, rows[:5]) == {}
    assert snapshot_changes(spark, rows[:0] or [(None, None, None, None, None, None, None)]) == {}


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="w"'


def read(spark, rows, limit=extract.MAX_BYTES):
    """Results of (suffix, bytes) in order."""
    df = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rows)], "i int, kind string, raw binary")
    return [r.r for r in df.select("i", extract.extract(F.col("kind"), F.col("raw"), limit).alias("r")).orderBy("i").collect()]


def test_office_documents(spark):
    docx = office({"word/document.xml": f"<w:d {W}><w:p><w:t>The ledger </w:t><w:t>is open</w:t></w:p><w:p/><w:p><w:t> second row </w:t></w:p></w:d>"})
    slide = lambda t: f'<a:s xmlns:a="a"><a:t>{t}</a:t></a:s>'
    pptx = office({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")})
    sheet = '<s><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in place</t></is></c><c r="C1"><v>7</v></c><c r="D1"/></s>'
    xlsx = office({"xl/sharedStrings.xml": "<x><si><t>shared</t></si></x>", "xl/worksheets/sheet1.xml": sheet})
    beyond = office({"xl/worksheets/sheet1.xml": '<s><c r="A1" t="s"><v>5</v></c></s>'})
    got = read(spark, [(".docx", docx), (".pptx", pptx), (".xlsx", xlsx), (".docx", b"no zip"), (".docx", office({"x": ""})), (".xlsx", beyond), (".docx", None)])
    assert (got[0].status, got[0].content, got[0].extractor) == ("extracted", "The ledger is open\nsecond row", "ooxml:docx")
    assert got[1].content == "Slide 2\ntwo\n\nSlide 10\nten" and got[2].content == "Sheet 1\nA1: shared\nB1: in place\nC1: 7"
    assert [g.status for g in got[3:]] == ["error"] * 4 and all(got[k].error.startswith("Extraction failed") for k in (4, 5)) and got[6].sha256 == ""
    bomb = office({"word/document.xml": f"<w:d {W}><w:p><w:t>{'a' * 20000}</w:t></w:p></w:d>"})
    assert len(bomb) < 2000 and [g.status for g in read(spark, [(".docx", bomb), (".txt", b"a" * 2001)], 2000)] == ["too_large", "too_large"]


def test_text_and_binary(spark):
    rows = [
        (".md", "글".encode()), (".txt", "한글 파일".encode("cp949")), (".bin", b"a\0b"), ("", b"plain"), (".bin", "hi".encode("utf-16")), (".bin", b""), (".pdf", b"%PDF-"), (".ppt", b"x"), (".txt", "\ufeffmarked".encode()), (".bin", b"\xff\xfea"),
        (".bin", bytes(range(1, 32)) * 3), (".txt", b"\xff\xff\x80a\x80"), (".bin", "한글 파일 두 개".encode("cp949")),
    ]
    got = read(spark, rows)
    assert [(g.status, g.content, g.extractor) for g in got[:2]] == [("extracted", "글", "text:utf-8-sig"), ("extracted", "한글 파일", "text:cp949")]
    assert got[2].status == "unsupported" and got[2].error == "Unsupported file type: .bin" and got[3].extractor == "text-sniffed:utf-8-sig" and (got[4].content, got[4].extractor) == ("hi", "text-sniffed:utf-16")
    assert (got[5].status, got[5].content) == ("extracted", "") and got[6].status == got[7].status == "error" and got[8].content == "marked" and got[9].status == got[10].status == "unsupported"
    assert got[11].extractor == "text:latin-1" and got[12].extractor == "text-sniffed:cp949" and got[0].sha256 == hashlib.sha256("글".encode()).hexdigest()


def tree(path):
    (path / "src/docs").mkdir(parents=True)
    (path / "src/node_modules").mkdir()
    (path / "src/x.git").mkdir()
    (path / "src/docs/aurora.md").write_text("Project Aurora 온도 보정은 김하늘이 맡는다.", encoding="utf-8")
    (path / "src/notes.txt").write_text("Aurora budget note", encoding="utf-8")
    (path / "src/route-map.bin").write_bytes(b"\0\1\2")
    (path / "src/data.csv").write_text("a,b")
    (path / "src/node_modules/skip.md").write_text("no")
    os.symlink(path / "src/notes.txt", path / "src/link.txt")
    (path / ".env").write_text(f"# settings\nexport SILTSTONE_ROOT=src\nSILTSTONE_HOME='home'\nSILTSTONE_CHUNK_BYTES=16\n")
    return Settings.load(str(path / ".env"), {})


def test_scan_prunes_and_never_follows_links(spark, tmp_path):
    entries, errors = scan.scan_tree(spark, tree(tmp_path))
    assert {(r.relative_path, r.kind) for r in entries.collect()} == {("docs", "directory"), ("docs/aurora.md", "file"), ("notes.txt", "file"), ("route-map.bin", "file")} and errors.count() == 0


def test_stable_bytes_refuse_links_and_changes(tmp_path):
    (tmp_path / "a").write_text("abc")
    os.symlink(tmp_path / "a", tmp_path / "b")
    assert extract.stable_bytes(str(tmp_path / "a"), 10, 3) == b"abc"
    for path, limit, size in (("b", 10, None), ("a", 10, 4)):
        with pytest.raises(OSError):
            extract.stable_bytes(str(tmp_path / path), limit, size)
    with pytest.raises(extract.TooLarge):
        extract.stable_bytes(str(tmp_path / "a"), 2)


def test_catalog_end_to_end(spark, tmp_path):
    given = tree(tmp_path)
    catalog = Catalog(spark, given)
    first = catalog.sync()
    assert first["counts"]["added"] == 4 and catalog.compile(first)["source_pages"] == 3
    assert catalog.lint().count() == 0 and (tmp_path / "home/AGENTS.md").is_file() and [r.relative_path for r in catalog.listed().collect()] == ["docs", "docs/aurora.md", "notes.txt", "route-map.bin"]
    assert catalog.postings.exceptAll(index.postings(catalog.chunks)).count() == 0 and catalog.stats.exceptAll(index.chunk_stats(catalog.chunks)).count() == 0
    assert (tmp_path / "home/wiki/index.md").read_text().splitlines()[6:] == [*[f"- [{p}]({text_path(spark, p)}) — {s}" for p, s in (("docs/aurora.md", "extracted, 55 bytes"), ("notes.txt", "extracted, 18 bytes"), ("route-map.bin", "unsupported, 3 bytes"))], "", "## Directories", "", "- `docs/`"]
    assert catalog.get("docs/aurora.md").first().content.startswith("Project Aurora")
    hit = catalog.search("누가 Aurora 온도보정").first()
    assert hit.relative_path == "docs/aurora.md" and (tmp_path / "home" / hit.wiki_path).is_file()
    (tmp_path / "src/notes.txt").write_text("Changed text entirely")
    os.remove(tmp_path / "src/docs/aurora.md")
    again = Catalog(spark, given)
    second = again.sync(retry_unreadable=True)
    assert {k: second["counts"][k] for k in ("added", "removed")} == {"added": 0, "removed": 1} and second["counts"]["updated"] + second["counts"]["unchanged"] == 3
    assert {r.relative_path for r in second["changed"].collect()} - {"docs"} == {"notes.txt"}
    assert again.postings.exceptAll(index.postings(again.chunks)).count() == 0 == index.postings(again.chunks).exceptAll(again.postings).count()
    assert again.compile(second)["removed_pages"] == 1 and again.search("Aurora").count() == 0 and again.search("Changed").count() == 1
    (tmp_path / "home/wiki/sources/stray.md").write_text("x")
    os.remove(tmp_path / "home/wiki/index.md")
    assert [r.message for r in again.lint().collect()] == ["Missing required file: index.md", "Orphan source page: stray.md"]
    manifest = tmp_path / "home/catalog.json"
    manifest.write_text(json.dumps({"snapshot": "x"}))
    with pytest.raises(CatalogError):
        Catalog(spark, given)


def text_path(spark, path):
    return spark.range(1).select(text.page_path(F.lit(path))).first()[0].removeprefix("wiki/")


def test_a_lost_root_changes_nothing(spark, tmp_path):
    given = tree(tmp_path)
    catalog = Catalog(spark, given)
    catalog.compile(catalog.sync())
    kept = catalog.manifest.read_text()
    os.rename(tmp_path / "src", tmp_path / "away")
    with pytest.raises(SettingsError):
        Settings.load(str(tmp_path / ".env"), {})
    with pytest.raises(CatalogError):
        Catalog(spark, given).sync()
    assert catalog.manifest.read_text() == kept and Catalog(spark, given).entries.count() == 4
    (tmp_path / "src").write_text("no folder")
    with pytest.raises(SettingsError):
        Settings.load(str(tmp_path / ".env"), {})


def test_what_a_scan_could_not_see_stays(spark):
    changes = spark.createDataFrame([("a", "removed"), ("a/b", "removed"), ("ab", "removed"), ("c/d/e", "removed"), ("f", "added"), ("a/g", "updated")], "relative_path string, change string")
    failed = spark.createDataFrame([("a",), ("c/d/e",), (None,)], "relative_path string")
    got = {r.relative_path: r.change for r in sync.spared(changes, failed).collect()}
    assert got == {"a": "unchanged", "a/b": "unchanged", "ab": "removed", "c/d/e": "unchanged", "f": "added", "a/g": "updated"}


def test_settings_errors_and_merging(tmp_path):
    (tmp_path / "bad").write_text("SILTSTONE_ROOT=/\nno value here\n")
    with pytest.raises(SettingsError, match="line 2"):
        Settings.load(str(tmp_path / "bad"), {})
    with pytest.raises(SettingsError, match="another folder"):
        Settings.load(None, {"SILTSTONE_ROOT": str(tmp_path), "SILTSTONE_HOME": str(tmp_path)})
    with pytest.raises(SettingsError):
        Settings.load(None, {})
    with pytest.raises(SettingsError):
        Settings.load(None, {"SILTSTONE_ROOT": "/", "SILTSTONE_CHUNK_BYTES": "0"})
    s = Settings.load(None, {"SILTSTONE_ROOT": "/", "SILTSTONE_EXCLUDED_DIRECTORIES": "Build, Extra;more", "SILTSTONE_EXCLUDED_EXTENSIONS": "*.LOG"})
    assert s.excluded_directories.count("build") + s.excluded_directories.count("Build") == 1 and s.excluded_directories[-2:] == ("Extra", "more") and ".log" in s.excluded_suffixes


def test_commands(spark, tmp_path, capsys):
    from siltstone.cli import main

    tree(tmp_path)
    env = ["--env-file", str(tmp_path / ".env")]
    told = lambda *command: (main([*env, *command, "--json"]), json.loads(capsys.readouterr().out))
    code, indexed = told("index")
    assert code == 0 and indexed["command"] == "index" and indexed["sync"]["added"] == 4 and indexed["sync"]["changed_path_count"] == 4 and "docs/aurora.md" in indexed["sync"]["changed_path_sample"]
    assert indexed["compiled"]["source_pages"] == 3 and os.path.isfile(indexed["wiki_index"]) and indexed["sync"]["removed_wiki_path_count"] == 0
    code, found = told("query", "Aurora", "--limit", "1")
    assert code == 0 and len(found["results"]) == 1 and os.path.isfile(found["results"][0]["wiki_path"]) and found["results"][0]["source_path"].startswith(str(tmp_path))
    code, status = told("status")
    assert code == 0 and (status["files"], status["directories"], status["extraction_status"]) == (3, 1, {"extracted": 2, "unsupported": 1})
    assert told("lint") == (0, {"command": "lint", "issues": [], "ok": True}) and "Query" in (tmp_path / "home/wiki/log.md").read_text()
    assert main([*env, "query", "Aurora", "--limit", "0"]) == 2 and main(["--env-file", str(tmp_path / "none"), "status", "--json"]) == 2
    out = capsys.readouterr()
    assert out.out == "" and "SILTSTONE_ROOT" in out.err


def test_stream_of_scans(spark, tmp_path):
    from siltstone.streaming.changes import follow

    schema = "relative_path string, kind string, size bigint, mtime_ns bigint, seen_at bigint"
    spark.createDataFrame([("a", "file", 1, 1, 1), ("a", "file", 2, 2, 2), ("b", "file", 1, 1, 1)], schema).write.parquet(str(tmp_path / "in/1"))
    old = spark.createDataFrame([(1, "a", "file", 2, 2, "extracted", "", "", ""), (2, "c", "file", 2, 2, "extracted", "", "", "")], ENTRY)
    seen = {}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = follow(stream, lambda: old, lambda df, n: seen.update({r.relative_path: r.change for r in df.collect()}), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert seen == {"a": "unchanged", "b": "added"}
