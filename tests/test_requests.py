import datetime

from atheneum.operators import requests
from atheneum.sources import schemas, store


def test_keyword_syntax(spark):
    q = requests.KeywordQuery.parse('red "exact phrase" {type:page} {in_name:alp} {created_by:me} [team=a] [draft]')
    assert (q.words, q.phrases, q.filters, q.tags) == (["red"], ["exact phrase"], {"type": "page", "in_name": "alp", "created_by": "me"}, {"team": "a", "draft": None})
    rows = spark.createDataFrame([(1, "page", "Alpha", "an Exact Phrase here", "u", {"team": "a", "draft": ""}), (2, "book", "Alpha", "exact phrase", "u", {"team": "a", "draft": ""}), (3, "page", None, None, None, None)], "id int, type string, name string, text string, created_by string, tags map<string,string>")
    assert [r.id for r in requests.keyword_filter(rows, '"exact phrase" {type:page} {in_name:alp} {created_by:me} [team=a] [draft]', "u").collect()] == [1]
    assert requests.keyword_filter(rows, "plain words").count() == 3


def test_named_scopes():
    definitions = {"a": {"books": [3, 1]}, "b": {"books": [1], "pages": [9]}}
    assert requests.named_scopes(definitions, ["a", "x", "b"]) == ({"shelves": [], "books": [1, 3], "chapters": [], "pages": [9]}, ["x"])


def test_time_block(monkeypatch):
    monkeypatch.setenv("DEFAULT_TIMEZONE", "No/Where")
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    assert requests.time_zone() == ("Asia/Tokyo", "tz")
    block = requests.time_block(datetime.datetime(2024, 5, 3, 15, 4, 5, tzinfo=datetime.timezone.utc), "Asia/Tokyo", "tz")
    assert (block["now_utc"], block["now_local"], block["now_human"]) == ("2024-05-03T15:04:05Z", "2024-05-04T00:04:05+09:00", "Saturday, May 4, 2024 at 12:04 AM JST")


def test_schemas(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    schemas.init(kept)
    schemas.init(kept)
    assert kept.read("chunks").count() == 0 and kept.get("schema_version") == schemas.VERSION
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in schemas.wrong_width(chunks, 2).collect()] == [2, 3]
