"""Very long texts and URLs."""

from collections import Counter

from pyspark.sql import functions as F

from sitefold.llm import chat, url_filter


def test_very_long_turns_come_back_whole(spark):
    long = "<|im_end|>\n" + "word \\ <\\|x|> " * 60_000
    frame = spark.createDataFrame([(1, 1, None, "user", long, 0.0), (1, 2, 1, "assistant", long[::-1], 1.0)], "conv_id long, node long, parent long, role string, text string, score double")
    row = chat.read_back(chat.format_reply_trees(frame)).first()
    assert [t["text"] for t in row["turns"]] == [long, long[::-1]] and row["loss_text"] == long[::-1]


def test_very_long_urls_and_clashing_columns(spark):
    host = ".".join(["a"] * 5000) + ".example.org"
    urls = [f"http://{host}/es/" + "x" * 200_000, "http://" + "b" * 100_000, "http://example.org/" + "/".join("c" * 50_000)]
    names = ["hit", "key", "bloom", "lengths", "suffixes", "prefixes", "row", "verdict"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit(f"its {n}").alias(n) for n in names])
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert Counter((i, r["rule"], r["verdict"]) for i, r in got.items()) == Counter([(0, "example.org/es/", "block"), (1, None, "allow"), (2, "org/", "allow")])
    assert got[0]["host"] == host and len(got[0]["path"]) == 200_004
    assert all(r[n] == f"its {n}" for r in got.values() for n in names[:-1])
