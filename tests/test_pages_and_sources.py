import datetime
import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prizelens.operators import pages as pg
from prizelens.operators.markup import elements
from prizelens.sources.log import RETRY, pending_keys, upsert_log
from prizelens.sources.pages import read_pages
from prizelens.sources.files import stored_files, write_files
from prizelens.sources.release import build_manifest, file_hashes, verify_manifest, write_release
from prizelens.sources.tables import (
    read_table,
    read_url_list,
    readable_encoding,
    with_row_number,
)
from prizelens.streaming.upsert import compact, read_log, stream_upsert

D = datetime.date


def pages(spark, *html, url="https://x.org/tournaments/7-cup"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id int, url string, html string")


def box(*pairs, title="Cup"):
    rows = "".join(
        f'<div class="format_row"><div class="info_text_header">{k}:</div><div class="info_text_value">{v}</div></div>'
        for k, v in pairs
    )
    return f'<main><div class="info_box"><h1 class="info_box_title">{title}</h1>{rows}</div>'


GOOD = [("Date", "2020-01-01 – 2020-01-03"), ("Game", '<a href="/games/231-x">Dota</a>'), ("Prize Pool", "$1,000.00"), ("Currency", "USD")]


def test_field_box(spark):
    got = pg.extract_fields(
        pages(spark, box(*GOOD), box(*GOOD[:2]), "<p>none", '<div class="format_row"><div class="info_text_header">Date')
    ).orderBy("page_id").collect()
    assert got[0]["fields"]["Game"] == "Dota" and got[0]["field_links"]["Game"] == "/games/231-x"
    assert [x["error"] for x in got] == [None, "missing_fields: Prize Pool, Currency", "missing_info_box", "missing_info_box"]


def test_parent_records(spark):
    swapped = [("Date", "2020-01-05 2020-01-03"), *GOOD[1:]]
    euro = [*GOOD[:2], ("Prize Pool", "€9"), ("Currency", "EUR")]
    got = pg.extract_parents(pages(spark, box(*GOOD), box(*swapped), box(*euro))).orderBy("page_id").collect()
    assert (got[0].start_date, got[0].pool_cents, got[0].source_game_id, got[0].source_tournament_id) == (
        D(2020, 1, 1), 100000, "231", "7")
    assert got[1].start_date is None and got[1].date_validation_status == "invalid_date"
    assert got[1].source_start_date == D(2020, 1, 5)
    assert got[2].error == "no_usd_amount"


def block(rank, prize, *teams):
    names = "".join(f'<span class="tournament_team_medalist_name">{t}</span>' for t in teams)
    return f'<div><b class="tournament_medalist_rank">{rank}</b><i class="tournament_medalist_prize">{prize}</i>{names}</div>'


def test_result_rows_and_batch(spark):
    good = box(*GOOD) + block("1st", "$600.00", '<a href="/teams/5-a">A</a>') + block("2nd-3rd", "$200.00", "B", "C") + "</main>"
    no_prize = box(*GOOD) + '<div><b class="tournament_medalist_rank">1st</b></div></main>'
    odd_rank = box(*GOOD) + block("best", "$5 ($1.00 USD)", "A") + "</main>"
    outside = box(*GOOD) + "</main>" + block("1st", "$600.00", "A")
    df = pages(spark, good, no_prize, odd_rank, outside, "<p>")
    currency = pg.extract_parents(df).select("page_id", "currency")
    got = pg.extract_children(df, currency).orderBy("page_id", "pos").collect()
    assert [(x.team_name, x.source_team_id, x.rank_min, x.rank_max, x.prize_cents) for x in got[:3]] == [
        ("A", "5", 1, 1, 60000), ("B", None, 2, 3, 20000), ("C", None, 2, 3, 20000)]
    assert got[0].team_url == "https://x.org/teams/5-a"
    assert [x.page_error for x in got[3:]] == ["missing_prize", "unreadable_rank", "no_results", "no_results"]
    audit = pg.extract_batch(df).orderBy("page_id").collect()
    assert [x.status for x in audit] == ["matched", "tournament_only", "tournament_only", "tournament_only", "failed"]
    stored = spark.createDataFrame([(0,), (0,)], "page_id int")
    seen = pg.page_evidence(df, stored).orderBy("page_id").collect()
    assert (seen[0].rank_blocks, seen[0].team_elements, seen[0].team_count_mismatch) == (2, 3, True)
    assert not seen[4].html_available


def country(code, name, money, players, cells=4):
    row = f'<tr class="format_row"><td>1.<td><a href="/countries/{code}">{name}</a><td>{money}'
    return row + (f"<td>{players}" if cells == 4 else "")


def table(*rows, heading="Prize Money By Country"):
    return f"<main><h2> {heading} </h2><div><table>{''.join(rows)}</table></div><h2>Next</h2><table>{country('zz', 'Z', '$1', '1 Player')}</table></main>"


def test_breakdown(spark):
    good = table(country("na", "Namibia", "$1,000.50", "1 Player"), country("us", "US", "$2.00", "12 Players"))
    cases = [
        good, table(country("na", "N", "$1", "1 Player", cells=3)), table(country("nam", "N", "$1", "1 Player")),
        table(country("na", "N", "$1", "one")), table(country("na", "N", "1K", "1 Player")),
        table(country("na", "N", "$1", "1 Player"), country("na", "N", "$1", "1 Player")), table(),
        table(heading="Other"), good + good,
    ]
    got = pg.extract_breakdown(pages(spark, *cases)).orderBy("page_id", "pos").collect()
    assert [(x.country_code, x.prize_cents, x.source_player_count) for x in got[:2]] == [("NA", 100050, 1), ("US", 200, 12)]
    assert [x.page_error for x in got[2:]] == [
        "country_table_structure", "country_code_invalid", "player_count_invalid", "invalid_money",
        "empty_or_duplicate_country_rows", "empty_or_duplicate_country_rows",
        "missing_or_ambiguous_country_heading", "missing_or_ambiguous_country_heading"]


def listing(*rows, tables=1, title="Cups"):
    head = "<thead><tr><th>Hours Watched<th>Peak Viewers<th>Event Date</thead>"
    return f"<title>{title}</title>" + f"<table>{head}<tbody>{''.join(rows)}</tbody></table>" * tables


def line(n, date="01.02.20", cells=7):
    return f'<tr><td><a href="/tournaments/cup/{n}/">Cup {n}</a>' + "<td>1" * (cells - 2) + f"<td>{date}"


def test_listing(spark):
    banner = '<tr><td colspan="7"><a class="meta-tournaments-dashboard" href="/p">Pro</a></td></tr>'
    cases = [
        listing(banner, line(1), line(2, "TBA"), line(3, "01.02.2030")), listing(line(1, cells=6)), listing(line(1), tables=2),
        listing(line(1), line(1)), listing(), listing(line(1), title="Just a moment..."),
    ]
    df = pages(spark, *cases, url="https://c.org/tournaments/cup")
    got = pg.extract_listing(df, ["c.org"], "cup", "2012-01-01", "2025-12-31").orderBy("page_id", "pos").collect()
    assert [(x.source_url, x.start_date_hint, x.scope_hint) for x in got[:3]] == [
        ("https://c.org/tournaments/cup/1", D(2020, 2, 1), "in_scope"),
        ("https://c.org/tournaments/cup/2", None, "unknown_date"),
        ("https://c.org/tournaments/cup/3", D(2030, 2, 1), "outside_scope")]
    assert [x.page_error for x in got[3:]] == [
        "listing_structure", "missing_or_ambiguous_listing_table", "listing_url_repeated", "empty_listing", "challenge_page"]


def test_script_text_and_comments_are_not_content(spark):
    html = '<main><!-- <h2>x</h2> --><script>var a = "<h2>Prize Money By Country</h2>";</script><h2>A &amp; B</h2></main>'
    nodes, texts = elements(html)
    assert [n.tag for n in nodes] == ["main", "script", "h2"] and texts == ["A & B"]


def test_navigation_and_reported_total(spark):
    html = '<p>From 1,234 Tournaments</p>Browse Events <a href="?page=2">2</a><a rel="next" href="/n">more</a><a href="/o">Older</a><a href="https://y.org/?a=1">next</a>'
    df = pages(spark, html, "<p>nothing</p>")
    got = {x.url for x in pg.extract_navigation(df).collect()}
    assert got == {"https://x.org/tournaments/7-cup?page=2", "https://x.org/n", "https://x.org/o"}
    assert [x.reported for x in pg.reported_total(df).orderBy("page_id").collect()] == [1234, None]


# --- sources -------------------------------------------------------------------------


def test_csv_keeps_na_and_reads_both_encodings(spark, tmp_path):
    utf, western = tmp_path / "a.csv", tmp_path / "b.csv"
    utf.write_bytes("﻿code,name\nNA,é\n,x\n".encode())
    western.write_bytes("code,name\nNA,é €\n".encode("cp1252"))
    schema = "code string, name string"
    encodings = [readable_encoding(spark, str(f)) for f in (utf, western)]
    assert encodings == ["UTF-8", "windows-1252"]
    assert [tuple(x) for x in read_table(spark, str(utf), schema).collect()] == [("NA", "é"), (None, "x")]
    assert [tuple(x) for x in read_table(spark, str(western), schema, encoding=encodings[1]).collect()] == [("NA", "é €")]


def test_many_files_each_by_its_own_encoding(spark, tmp_path):
    for i in range(10_000):
        text = f"code,name\n{i},é{i}\n{i},Ã© plain\n"
        (tmp_path / f"{i}.csv").write_bytes(text.encode("cp1252" if i % 3 == 0 else "utf-8"))
    (tmp_path / "marked.csv").write_bytes("\ufeffcode,name\n-1,ß €\n".encode())
    (tmp_path / "empty.csv").write_bytes(b"code,name\n")
    df = read_table(spark, str(tmp_path), "code int, name string", encoding="auto")
    # In UTF-8, the bytes of "Ã©" in windows-1252 would be "é": the whole file decides.
    bad = df.where(~F.col("name").isin("Ã© plain", "ß €") & (F.col("name") != F.concat(F.lit("é"), "code")))
    assert df.count() == 20_001 and bad.count() == 0


def test_names_of_a_header_by_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffpaís,x\nñ,1\n".encode())
    got = read_table(spark, str(tmp_path), encoding="auto")
    assert got.columns == ["país", "x"] and [tuple(r) for r in got.collect()] == [("ñ", "1")]


def test_digest_of_a_file_beyond_the_chunk(spark, tmp_path):
    folder = tmp_path / "v 1"
    (folder / "deep").mkdir(parents=True)
    data = bytes(range(256)) * 4096
    (folder / "big.bin").write_bytes(data)
    (folder / "deep" / "small é.bin").write_bytes(b"abc")
    (folder / "none.bin").write_bytes(b"")
    got = {x.file: (x.bytes, x.sha256) for x in file_hashes(spark, str(folder), chunk=1000).collect()}
    assert got == {
        "big.bin": (len(data), hashlib.sha256(data).hexdigest()),
        "deep/small é.bin": (3, hashlib.sha256(b"abc").hexdigest()),
    }
    plan = stored_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_row_numbers_of_a_split_csv(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("n\n" + "\n".join(str(i) for i in range(2, 40002)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_table(spark, str(path), "n long")
        assert df.rdd.getNumPartitions() > 3
        out = with_row_number(df, "csv")
        assert out.where(F.col("n") != F.col("source_row_number")).count() == 0
        assert out.count() == 40000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_url_list_ignores_namespace(spark, tmp_path):
    path = tmp_path / "s.xml"
    path.write_text('<urlset xmlns="http://s.org/0.9"><url><loc> https://a </loc></url><url><loc></loc></url></urlset>')
    assert [x.loc for x in read_url_list(spark, str(path)).collect()] == ["https://a"]


def test_pages_need_their_metadata(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.html").write_text(f"<p>{n}é\n</p>")
    (tmp_path / "a.json").write_text(json.dumps({"source_url": "https://a", "crawled_at": "t"}, indent=1))
    got = read_pages(spark, str(tmp_path)).collect()
    assert [(x.page_id, x.url, x.html) for x in got] == [("a", "https://a", "<p>aé\n</p>")]


def test_files_are_written_without_a_folder_each(spark, tmp_path):
    rows = [("a.txt", "é"), ("b.txt", None), ("a.txt", "é"), ("c d%.txt", "x\ny")]
    df = spark.createDataFrame(rows, "name string, content string").coalesce(1)
    (folder,) = write_files(df, f"file:{tmp_path}/w")
    found = {f.name: f.read_bytes().decode() for f in (tmp_path / "w").rglob("*") if f.is_file()}
    # Rows of one name share a file; no checksum files and one folder per partition.
    assert found == {"a.txt": "é\né\n", "b.txt": "\n", "c d%.txt": "x\ny\n"}
    assert len([f for f in (tmp_path / "w").rglob("*") if f.is_dir()]) == 1
    assert stored_files(spark, folder).count() == 3
    assert write_files(df.limit(0), f"{tmp_path}/none") == []


def test_stored_pages_are_dealt_to_few_folders(spark, tmp_path, monkeypatch):
    from prizelens.queries import sources

    monkeypatch.setattr(sources, "new_run_dir", lambda spark, label: f"{tmp_path}/kept")
    rows = [(i, f"https://x/{i}", f"<p>{i}</p>") for i in range(40)] + [(40, "u", None), (None, "v", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    found = sources.pages_with_metadata(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # An id that is no number has no key.
    want = {("" if i is None else str(i), u, sha(h or "")) for i, u, h in rows}
    assert {tuple(x) for x in found} == want and len(found) == len(rows)
    assert len([f for f in (tmp_path / "kept").rglob("*") if f.is_dir()]) <= 6
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert sources.pages_with_metadata(spark, f"{tmp_path}/empty").count() == 0


def test_release_is_immutable_and_verified(spark, tmp_path):
    df = spark.range(5)
    folder = str(tmp_path / "v1")
    write_release(df, str(tmp_path), "v1", "t")
    with pytest.raises(Exception, match="exists"):
        write_release(df, str(tmp_path), "v1", "t")
    counts = spark.createDataFrame([("t", 5)], "name string, value long")
    checks = spark.createDataFrame([("key", True)], "check string, passed boolean")
    manifest = build_manifest(spark, folder, counts, checks)
    manifest.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert {x.state for x in verify_manifest(spark, folder, stored).collect()} == {"unchanged"}
    victim = sorted((tmp_path / "v1" / "t").glob("*.parquet"))[0]
    # The local file system keeps its own checksum file; a real store has none.
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes() + b"x")
    (tmp_path / "v1" / "extra.bin").write_bytes(b"1")
    gone = sorted((tmp_path / "v1" / "t").glob("*.parquet"))[1]
    gone.unlink()
    states = {x.file.split("/")[-1]: x.state for x in verify_manifest(spark, folder, stored).collect()}
    assert states[victim.name] == "changed" and states["extra.bin"] == "unexpected"
    assert states[gone.name] == "missing" and "unchanged" in states.values()


def test_upsert_is_idempotent_and_resume_filter(spark):
    a = spark.createDataFrame([("1", 1, "failed"), ("2", 1, "matched")], "k string, ts int, status string")
    b = spark.createDataFrame([("1", 2, "matched"), ("3", 0, "tournament_only")], a.schema)
    tie = [F.col("status")]
    once = upsert_log(a, b, "k", "ts", tie)
    twice = upsert_log(once, b, "k", "ts", tie)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [
        ("1", 2, "matched"), ("2", 1, "matched"), ("3", 0, "tournament_only")]
    keys = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "k string")
    assert sorted(x.k for x in pending_keys(keys, once, "k").collect()) == ["3", "4"]
    assert "failed" in RETRY


def test_stream_upsert_runs_again_and_after_a_lost_batch(spark, tmp_path):
    schema = "k string, ts int, status string"
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream_upsert(spark, inbox, out, state, schema, "k", "ts")
        return sorted(tuple(x) for x in read_log(spark, out, "k", "ts").select("k", "ts", "status").collect())

    arrive(("1", 1, "a"), ("2", 5, "b"))
    first = run()
    assert first == [("1", 1, "a"), ("2", 5, "b")]
    assert run() == first
    arrive(("1", 2, "c"), ("2", 4, "old"))
    expected = [("1", 2, "c"), ("2", 5, "b")]
    assert run() == expected
    compact(spark, out, "k", "ts")
    assert run() == expected
    # A base that was not finished does not count.
    (tmp_path / "out" / "base=9").mkdir()
    assert run() == expected
    arrive(("3", 1, "n"))
    assert run() == [*expected, ("3", 1, "n")]


def test_links_of_awkward_markup(spark):
    html = (
        '<!-- <a href="/no">x</a> --><a href="/x?a=1&amp;b=2">one &amp; only</a>'
        '<a data-href="/bad" href="/good"><b>two</b></a>'
        """<a href="/it's">three</a><a title="a href='/trap'" href=/plain>four</a><a name="n">none</a>"""
    )
    pages = spark.createDataFrame([(1, "http://h/p", html)], "page_id int, url string, html string")
    got = [(x.pos, x.href, x.label) for x in pg.page_links(pages).orderBy("pos").collect()]
    assert got == [
        (0, "/x?a=1&b=2", "one & only"), (1, "/good", "two"), (2, "/it's", "three"), (3, "/plain", "four"),
    ]


def test_first_link_of_each_item_in_a_region(spark):
    html = '<a href="/e/1">out</a><main><a href="/e/2">a</a><a href="/e/2">b</a><a href="/e/3">c</a></main>'
    pages = spark.createDataFrame([(1, "http://h/p", html)], "page_id int, url string, html string")
    got = pg.extract_links(pages, {"e": r"^/e/(\d+)$"}, r"(?s)<main>(.*)</main>", keep_first=True)
    assert sorted((x.item_id, x.label) for x in got.collect()) == [("2", "a"), ("3", "c")]


def test_links_of_broken_and_long_tags(spark):
    long_tag = f'<a data-x="{"y" * 200_000}" href="/long">long</a>'
    bare = "<a href=" + "z" * 200_000 + ">bare</a>"
    cases = [
        long_tag + bare,
        '<a href="/1">one</a> <a <p>x</p><a href="/2">two</a>',
        '<a href="/1">one</a> <a title="open <a href=/2>two</a> <a href="/3">three</a>',
        '<a href="/1">one</a> <a href="/never',
        '<a href="/caf&#233;?a=1&amp;b&#x3D;2">&eacute;t&eacute; &nbsp;&#8364;</a>',
        "<a '>' " * 30_000, "<!-- " * 30_000 + '<a href="/x">x</a>', "< a href='/x'> 1 < 2 <a href='/y'>y", None,
        '<A HREF="/up" href="/no">Up</A><script>"<a href=/s>"</script><a href="/1">open<a href="/2">next</a>',
    ]
    df = pages(spark, *cases)
    got = {}
    for x in pg.page_links(df).orderBy("page_id", "pos").collect():
        got.setdefault(x.page_id, []).append((x.href, x.label))
    assert [(len(h), t) for h, t in got[0]] == [(5, "long"), (200_000, "bare")]
    assert ("/2", "two") in got[1] and ("/3", "three") in got[2] and got[3] == [("/1", "one")]
    assert got[4] == [("/café?a=1&b=2", "été €")]
    assert got[7] == [("/y", "y")] and set(got) == {0, 1, 2, 3, 4, 7, 9}
    assert got[9] == [("/up", "Up"), ("/1", "open"), ("/2", "next")]
    assert [x.url for x in pg.extract_navigation(df).collect()] == ["https://x.org/2"]


def test_listing_links_of_the_first_cell_and_game(spark):
    other = '<tr><td><a href="/tournaments/cup/1">Cup</a><td><a href="/tournaments/cup/2">x</a><td>3<td>4<td>5<td>6<td>01.02.20'
    foreign = '<tr><td><a href="/tournaments/chess/1">C</a>' + "<td>1" * 6
    deep = '<tr><td><a href="/tournaments/cup/1/tournaments/cup/2">C</a>' + "<td>1" * 6
    two = '<tr><td><a href="/tournaments/cup/1">a</a><a href="/tournaments/cup/2">b</a>' + "<td>1" * 6
    df = pages(spark, *[listing(x) for x in (other, foreign, deep, two)], url="https://c.org/tournaments/cup")
    got = pg.extract_listing(df, ["c.org"], "cup", "2012-01-01", "2025-12-31").orderBy("page_id").collect()
    assert got[0].source_url == "https://c.org/tournaments/cup/1" and got[0].page_error is None
    assert [x.page_error for x in got[1:]] == ["listing_url_missing_or_ambiguous"] * 3


def test_batch_checks_ids_and_repeated_teams(spark):
    good = box(*GOOD) + block("1st", "$1,000.00", "A") + "</main>"
    twice = box(*GOOD) + block("1st", "$500.00", "A") + block("2nd", "$500.00", "A") + "</main>"
    df = pages(spark, good, good, twice).withColumn("file_id", F.when(F.col("page_id") == 1, "8").otherwise("7"))
    got = pg.extract_batch(df, expected_id=F.col("file_id")).orderBy("page_id").collect()
    assert [(x.status, x.error) for x in got] == [
        ("matched", None), ("failed", "id_mismatch"), ("tournament_only", "repeated_team")]
    no_id = pages(spark, good, url="https://x.org/other")
    assert pg.extract_batch(no_id, expected_id=F.lit("7")).first().error == "url_without_id"


def test_tournament_jobs_share_one_scan(spark):
    good = box(*GOOD) + block("1st", "$1,000.00", "A") + "</main>"
    parsed = pg.tournament_blocks(pages(spark, good))
    for out in (pg.extract_parents(parsed), pg.extract_children(parsed, currency_field="Currency"),
                pg.extract_breakdown(parsed), pg.extract_batch(parsed)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [parse(") == 1 and "Join" not in plan
    assert pg.extract_children(parsed, currency_field="Currency").first().prize_cents == 100000


def test_one_bad_row_stops_nothing(spark):
    from prizelens.functions import money as m

    df = spark.createDataFrame(
        [("3000000000",), ("99999999999999999",), ("$99999999999999999999",), ("12.50",)], "x string"
    )
    got = df.select(m.rank_number(F.col("x")).alias("r"), m.to_cents(F.col("x")).alias("c")).collect()
    assert [x.r for x in got] == [3000000000, 99999999999999999, None, None]
    assert [x.c for x in got] == [300000000000, None, None, 1250] or got[1].c == 9999999999999999900


def test_quantiles_of_a_crowded_range(spark):
    from prizelens.operators.quantiles import _counts_and_parts, exact_quantiles

    df = spark.range(0, 200_000).select(F.lit(1).alias("g"), (F.col("id") + 1_700_000_000).alias("x"))
    row = exact_quantiles(df, ["g"], "x", {"median": 0.5}).first()
    assert row.median == 1_700_000_000 + 99_999.5
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # small partitions are else put together
    _, located = _counts_and_parts(df, ["g"], "x")
    assert located.agg(F.max("_in_part")).first()[0] < 200_000 / 4
    spark.conf.set(name, "true")
    odd = spark.createDataFrame([(1, float("inf")), (1, 1.0), (1, 3.0)], "g int, x double")
    assert exact_quantiles(odd, ["g"], "x", {"median": 0.5}).first().median == 3.0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rendered_pages_are_dealt_by_key_not_to_a_fixed_number(spark, sf):
    from prizelens.queries import page_jobs as jobs

    for pages_of in (jobs.head_pages, jobs.nation_pages, jobs.tournament_pages):
        assert "RepartitionByExpression [page_id" in _plan(pages_of(spark, sf))


def test_scan_holds_few_pages_at_a_time_and_keeps_odd_pages(monkeypatch):
    import pyarrow as pa

    from prizelens.operators import markup

    html = ['<h2>A > B</h2>tail > x', None, '<H2 title="a>b">B<br>&amp;<script><h2>no</h2></script></h2>',
            "<!-- <h2>c</h2> --><h2>D", "< b <h2>E</h2>", ""]
    kinds = {"heads": markup.Blocks(markup.Select(tag="h2", keep=("title",)))}
    whole = markup.scan_batch(pa.array(html), kinds).to_pylist()
    monkeypatch.setattr(markup, "CHUNK", 0)
    assert markup.scan_batch(pa.array(html), kinds).to_pylist() == whole
    assert [[b["text"] for b in x["heads"]] for x in whole] == [["A > B"], [], ["B &"], ["D"], ["E"], []]
    assert whole[2]["heads"][0]["attrs"] == {"title": "a>b"}
    assert [e.tag for e in elements(html[2])[0]] == ["h2", "br", "script"]


def test_last_value_of_a_repeated_label_counts(spark):
    row = '<div class="format_row"><b class="info_text_header">{}:</b><b class="info_text_value">{}</b></div>'
    rows = [("Date", "2020-01-01"), ("Game", "x"), ("Date", "2021-01-01"), ("Currency", "USD")]
    html = '<div class="info_box"><h1 class="info_box_title">T</h1>' + "".join(row.format(*r) for r in rows) + "</div>"
    got = pg.extract_fields(pages(spark, html)).collect()[0]
    assert got.fields == {"Game": "x", "Date": "2021-01-01", "Currency": "USD"}
    assert got.error == "missing_fields: Prize Pool"


def test_what_is_found_goes_to_spark_in_small_parts(spark, monkeypatch):
    from prizelens.operators import markup

    rows = "".join(f"<tr><td>{i}<td><a href='/x/{i}'>x</a>" for i in range(20))
    html = pa.array([f"<table>{rows}</table>", None, "<p>"] * 30)
    kinds = {"lines": markup.Blocks(markup.Select(tag="tr"), {"cell": markup.Select(tag="td")})}
    whole = markup.scan_batch(html, kinds).to_pylist()
    monkeypatch.setattr(markup, "CHUNK", 1000)
    parts = list(markup.scan_parts(html, kinds))
    assert max(map(len, parts)) < 10 and [x for p in parts for x in p.to_pylist()] == whole
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(html.to_pylist())], "page_id int, html string")
    got = {r.page_id: r.lines for r in markup.page_blocks(pages, kinds).collect()}
    assert [[b.pos for b in got[i]] for i in range(90)] == [[b["pos"] for b in x["lines"]] for x in whole]


@pytest.mark.parametrize("html", [
    "<!DOCTYPE html><table class='x'><tr><td>1 &amp; 2<td>3</table> tail", "a<b>c</b>d<br/><a href='?'>e",
    "<h2 title='a > b'>x</h2><td>y", "<p>\0b</p>a > b<td>c<table><td>\0</table>d<tr>e", "<p>1 < 2<!-- <h2> --></p><script>'<td>'</script><td>z", "<td title='open>x</td><td>y",
])
def test_pages_read_alike_tag_by_tag(monkeypatch, html):
    from prizelens.operators import markup

    cell = markup.Select(tag="td", keep=("title",))
    kinds = {"all": markup.Blocks(markup.Select()), "cells": markup.Blocks(cell, {"in": markup.Select()}, up=1)}
    quick = markup.scan_batch(pa.array([html]), kinds).to_pylist()
    monkeypatch.setattr(markup, "split_tokens", markup.stepped_tokens)
    assert markup.scan_batch(pa.array([html]), kinds).to_pylist() == quick
    counts = {k: markup.Blocks(markup.Select(tag="td", text=False)) for k in ("n",)}
    found = markup.scan_batch(pa.array([html]), counts).to_pylist()[0]["n"]
    assert found == [{"pos": b["pos"]} for b in quick[0]["cells"]]
