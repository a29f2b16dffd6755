"""The quality stage removes boilerplate lines from the documents that it keeps."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Per host 60 documents with a short line (below line dedup's 40 code points) twice, and a depleted one; a host in which it isn't frequent."""
    out, n = [], 0
    for host, of in (("a", 60), (None, 60), ("b", 40)):
        for k in range(of):
            own = [" ".join(f"{part}{n}w{i}" for i in range(15)) for part in "xy"]
            text = "\n".join((own[0], "  Share THIS page 7\t", "", own[1], "share this  page 8", ""))
            out.append((n, text, "en", host, len(text)))
            n += 1
        out.append((n, "".join(f"share this page {j}\n" for j in range(5)) + "z " + " ".join(f"v{i}" for i in range(10)), "en", host, 1))
        n += 1
    return out


def test_short_boilerplate_goes(spark):
    docs = rows()
    want, seen = [], set()
    for d, text, _, host, _ in docs:
        if text.startswith("share"):
            if host == "b":
                want.append((d, text))
            continue
        if host != "b" and host in seen:
            text = "\n".join(x for x in text.split("\n") if "share" not in x.lower())
        seen.add(host)
        want.append((d, text))
    got = cp.quality_rules(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_judged_shows_places_only_on_request(spark):
    from strandframe.llm import quality

    docs = spark.createDataFrame(rows(), SCHEMA)
    plain, placed = quality.judged(docs), quality.judged(docs, places=True)
    assert placed.columns == [*plain.columns, "lost_lines"]
    assert sorted(map(str, placed.drop("lost_lines").collect())) == sorted(map(str, plain.collect()))
    assert [(r.n_lost > 0) for r in placed.collect()] == [(r.lost_lines is not None) for r in placed.collect()]
