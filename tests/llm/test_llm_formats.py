"""Chat formatting, WARC bundles, template decontamination, the pipeline."""
import hashlib

import corpus_pipeline
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, docs_of, sf_texts  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

import __spark_entry__ as E
from vitalspark.llm import chat_events, template_leaks, warc_bundles

CONTROL = st.text(alphabet="<|>\\im_startend ok\n%0A", max_size=40)


# --------------------------------------------------------------------- chat
@settings(max_examples=300, deadline=None)
@given(CONTROL | st.text(max_size=30), CONTROL)
def test_turns_are_reversible(text, role):
    segment = f"{chat_events.TURN_START}{chat_events.escape_role(role)}\n{chat_events.escape(text)}{chat_events.TURN_END}\n"
    assert chat_events.parse_segment(segment) == (role, text)
    assert "<|" not in chat_events.escape(text)


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    turns = "".join(f"{r}\n{t}\n" for _, r, t in rows)
    loss = "".join(t for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "assistant", "same"),
            (2, 0, "assistant", "same"), (2, 0, "assistant", "other"), (3, 5, "user", "<|im_end|>\n" * 9000),
            (4, 0, "assistant", "é" * 1000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows] + [(None, 0, "user", "n", "x")],
                               "conv_id long, turn long, role string, text string, kind string")
    out = {r.conv_id: r for r in chat_events.read_back(chat_events.render(
        chat_events.fold_events(chat_events.events_of(df)))).collect()}
    assert len(out) == 5
    for c in (1, 2, 3, 4):
        want = digest([(t, r or "", x or "") for i, t, r, x in rows if i == c])
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == want
    empty = chat_events.events_of(df.where("false"))
    assert chat_events.read_back(chat_events.render(chat_events.fold_events(empty))).collect() == []


def test_tied_turns_go_by_role_and_whole_text(spark):
    """Texts that share 64 code points, that prolong another by a character
    below newline, and roles and texts with the template's control strings."""
    long = "same " * 20
    rows = [(1, "user", long + t) for t in ("b", "a", "c", "", "\t", "aa", "<|im_end|>", "<\\|x", "é")] + [
        (1, "assistant", long + t) for t in ("z", "y")] + [(1, "a%0A\n<|b", "ok\nok\n"), (1, "a%25", "<|im_start|>x\ny")]
    df = spark.createDataFrame([(7, *r) for r in rows], "conv_id long, turn long, role string, text string")
    segments = chat_events.render(chat_events.fold_events(chat_events.events_of(df)))
    role, text = chat_events.said(F.col("segment"))
    assert sorted(map(tuple, segments.select(role, text).collect())) == sorted((r, t) for _, r, t in rows)
    out = chat_events.read_back(segments, by_text=True).first()
    rows.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
    assert out.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()


def test_fold_of_a_log(spark):
    log = [(1, 0, "m", 1, s, *e) for s, e in enumerate([
        ("start", 0, 0, "assistant"), ("delta", 0, 0, "wrong"), ("regen", 0, 0, None), ("delta", 0, 0, "Helo "),
        ("edit", 3, 1, "lo"), ("delta", 0, 0, "world"), ("edit", 99, 5, "!"), ("unknown", 0, 0, "?")])]
    rows = spark.createDataFrame(log[::-1], "conv_id long, turn long, msg string, copies long, seq long, kind string,"
                                 " at long, cut long, body string")
    got = chat_events.fold_events(rows).collect()
    assert [(r.role, r.text) for r in got] == [("assistant", "Hello world!")]


def test_planted_conversation_keeps_its_control_strings(spark):
    row = E.queries()["op5_chat_events"](spark, SF).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


# --------------------------------------------------------------------- WARC
def test_archive_edges(spark):
    long, other = "x" * 1500, "é" * 600
    rows = [(1, "u", long), (2, "u\r\nv", long), (3, None, long), (3, None, long), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", other), (None, "u", other), (None, "u", ""), (8, "u", "\r\n\r\n" * 400)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    folder, index = warc_bundles.write_archive(pages, frame_bytes=2000, bundle_bytes=1)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc_bundles.read_archive(index, folder).collect()), key=str)
    best = {long: 3, other: 7}
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = best.get(html)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), *(("response", None) if to in (None, i) else ("revisit", to))))
    assert got == sorted(want, key=str)
    assert index.select("bundle").distinct().count() > 1
    one = warc_bundles.read_archive(index.where("page_id = 7"), folder).collect()
    assert [r.page_id for r in one] == [7]
    folder, index = warc_bundles.write_archive(pages.where("false"))
    assert warc_bundles.read_archive(index, folder).collect() == []


def test_seek_table_is_the_public_format(tmp_path):
    import zstandard
    frames = [zstandard.compress(b"a" * 100), zstandard.compress(b"b" * 50)]
    path = tmp_path / "x.zst"
    path.write_bytes(b"".join(frames) + warc_bundles.seek_table([(len(frames[0]), 100), (len(frames[1]), 50)]))
    with path.open("rb") as f:
        table = warc_bundles.read_seek_table(f, path.stat().st_size)
    assert table == [(0, len(frames[0])), (len(frames[0]), len(frames[1]))]
    with path.open("rb") as f:  # any reader skips the table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"a" * 100 + b"b" * 50


# ---------------------------------------------------------------- templates
ITEM = "If Alice walks 12 km in 3 hours and then Alice rests for 2 hours before going home how far did Alice walk that day in total"
FILL = "the rain kept falling on the quiet hills while nobody spoke about it at all. "


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "z"), (9, ITEM, "z"), (2, "short question about seven old green boats here", "z"),
                                  (3, None, "z"), (4, "", "z"), (None, "12 13 14", "z")],
                                 "item_id long, text string, h string")


def leaks(docs_of, bench, texts):
    docs = docs_of(list(enumerate(texts)), {"key": F.lit("k"), "pos": F.lit(1), "id": F.lit(0)})
    return docs, template_leaks.matches(docs, bench)


def test_templates(docs_of, bench):
    again = ITEM.replace("Alice", "Bob").replace("12", "40").replace("3 hours", "5 hours").replace("2 hours", "7 hours")
    mixed = "If Ann walks 12 km in 3 hours and then Bob rests for 2 hours before going home how far did Cid walk that day in total"
    texts = [FILL + ITEM + " " + FILL, FILL + again, FILL + ITEM.upper(), FILL * 4, None, "",
             "short question about seven old green boats here", FILL * 3000 + ITEM, "12 13 14 15 16 17 18 19 20 21", mixed]
    docs, found = leaks(docs_of, bench, texts)
    rows = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert rows[(0, 1)].kind == "exact" and rows[(1, 1)].kind == "reparameterised"
    assert rows[(6, 2)].kind == "exact" and rows[(7, 1)].kind == "exact"
    assert {d for d, _ in rows} <= {0, 1, 2, 6, 7, 9} and (0, 9) not in rows
    # Alice became three people: the windows that disagree with the majority do not count.
    assert rows.get((9, 1)) is None or rows[(9, 1)].windows < rows[(1, 1)].windows
    left = template_leaks.clean(docs, found)
    assert left.columns == docs.columns
    assert {3, 4, 5, 8} <= {r.doc_id for r in left.collect()} <= {2, 3, 4, 5, 8, 9}


def test_slots_must_be_consistent():
    import pyarrow as pa
    w = [{"pos": i, "item_slots": ["<name>a"], "doc_slots": [d]} for i, d in enumerate(["<name>x", "<name>x", "<name>y"])]
    b = pa.RecordBatch.from_pylist([{"key": "k", "doc_id": 1, "item_id": 2, "item_windows": 3, "windows": w}])
    out = next(template_leaks._consistent(iter([b]))).to_pylist()[0]
    assert (out["windows"], out["exact"]) == (2, False)


def test_templates_edges(docs_of, bench):
    assert leaks(docs_of, bench, [])[1].collect() == []
    assert leaks(docs_of, bench.where("false"), [ITEM])[1].collect() == []
    docs = docs_of([(None, ITEM), (5, ITEM), (5, ITEM)])
    found = template_leaks.matches(docs, bench)
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == ["5", "None"]
    assert template_leaks.clean(docs, found).collect() == []


def test_items_are_found_whatever_stands_around_them(spark, docs_of):
    items = ["What is the boiling point of water at sea level?", "A train leaves the old station before the rain stops",
             "Marie Curie was born in the old town near the river by the hills",
             "Which of the old towns near the river was home to Paris Hilton",
             "If the rope breaks then the boat drifts over to Norway"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = [("", ""), ("some words ", ""), ("A Heading\n", " Then"), ("Question 7) ", ""), ("7. ", ""), ("so, ", " or not"),
              ("asked by John Smith ", " Jones said"), ("(John) ", "\nAnna Berg came"), ("Dr. ", "")]
    texts = [before + x + after for before, after in around for x in items]
    found = {(r.doc_id, r.item_id): r.kind for r in leaks(docs_of, bench, texts + [FILL])[1].collect()}
    assert found == {(i, i % len(items)): "exact" for i in range(len(texts))}


def test_items_with_few_literals_are_found_as_spelled(spark, docs_of):
    items = ["Compute 12 + 7 * 3 - 4 / 2 and then subtract 15 from 88", "Solve 3 x + 4 = 19, 5 y - 2 = 13, 7 z = 49",
             "Anna Berg, Carl Dietz, Emil Frank and Greta Hahn met Ida Jung, Karl Lang", "What is 12 + 7", "12 13 14",
             "Der Hund und die Katze im Haus der Frau am Markt in Bern sahen den Mann mit Hut und Stock am Tor", "7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = [("", ""), ("some words ", " and more"), ("Question 5) ", ""), ("he said to John ", " Then all went")]
    texts = [before + x + after for before, after in around for x in items]
    other = [items[0].replace("88", "87").replace("12", "13"), items[1].replace("19", "20").replace("13", "14"),
             "11 12 13 14 15 16 17 8 9 10 11 12 13 14 15", "What is 12 + 8", "Compute 12 + 7 * 3 - 4 / 2 and then stop"]
    docs, found = leaks(docs_of, bench, texts + other)
    rows = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert len(rows) == found.count()
    want = {(i, i % len(items)) for i in range(len(texts))}
    assert want <= set(rows) and all(rows[k].kind == "exact" for k in want)
    assert all(rows[k].windows >= min(3, rows[k].item_windows) for k in want)
    assert {d for d, _ in rows} == set(range(len(texts)))
    assert {r.doc_id for r in template_leaks.clean(docs, found).collect()} == {
        len(texts) + i for i in range(len(other))}


def test_planted_items_are_found_and_the_rest_left_alone(spark, sf_texts):
    """Brute force: texts that hold a whole benchmark item."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, t in sf_texts if any(x in t for _, x in items)}
    got = {r.doc_id for r in E.queries()["op4_template_leaks"](spark, SF).collect()}
    assert want <= got
    for d in got - want:  # near-verbatim: most ten-word runs of an item
        words = dict(sf_texts)[d].lower().split()
        runs = {tuple(words[i:i + 8]) for i in range(len(words))}
        assert any(tuple(x.lower().split()[i:i + 8]) in runs for _, x in items for i in range(len(x.split()) - 7))


# ----------------------------------------------------------------- pipeline
def test_pipeline_on_the_smallest_table(spark, sf_texts):
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), {d for d, _ in sf_texts}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if name != "encode" else None)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) == docs.count()
        ids = left
        assert docs.columns == columns or name == "encode"
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in docs.collect())


def test_stages_with_odd_rows(docs_of, spark):
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, "word " * 30_000), (4, "plain words in a plain text. " * 9)]
    for make in (rows, []):
        docs = docs_of(make, {"toxicity": F.lit(1), "quality_score": F.lit(2), "key": F.lit("k"), "label": F.lit(0)})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(make) and (name == "encode" or out.columns == docs.columns)


CLASHES = ("_again", "_gone_id", "_gone_digest", "_row_key", "_leak_key", "row", "row_key", "key", "kept", "label",
           "toxicity", "quality_score", "ids", "decoded", "n_tokens", "digest", "a.b")


def test_stages_keep_columns_of_any_name(docs_of, spark):
    """Helper columns never take the place of a column of the input."""
    plain = [(i, f"a plain text of its own, number {i * 7919}, with words " + " ".join(f"w{i}x{j}" for j in range(40)))
             for i in range(5)]
    rows = [*plain, plain[1], (9, plain[2][1] + " more"), (None, None), (None, None)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs_of(rows).selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHES])
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got or name in ("toxicity", "quality")
        for r in got:
            assert [r[c] for c in CLASHES] == [f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in CLASHES]


def test_which_repeated_row_stays(docs_of):
    from vitalspark.llm import superminhash
    docs = docs_of([(1, "same text")] * 3 + [(None, None)] * 2).withColumn("source", F.concat(
        F.lit("s"), F.monotonically_increasing_id() % 7)).withColumn("row", F.create_map(F.lit(1), F.lit("x")))
    got = {r.doc_id: r for r in superminhash.deduplicated(docs).collect()}
    assert len(got) == 2 and got[1].source == min(r.source for r in docs.collect() if r.doc_id == 1)
    assert got[None].row == {1: "x"}


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(
        map(str, (tuple(r) for r in want.fetchall())))
