import random

import numpy as np

from quern.llm.boilerplate import Page, aligned, article_blocks, decode
from quern.llm.trees import BoostedTrees

BODY = ["The night team counted {n} nests along the canal.", "Residents near the bridge saved {n} euro on their bills.", "Two schools planted {n} trees with help from the council."]


def page(i, layout, rng):
    body = [rng.choice(BODY).replace("{n}", str(rng.randint(2, 99))) + f" It is report {i}." for _ in range(rng.randint(3, 7))]
    menu, foot = ["Home | News | About us | Search"], ["Share this page", "You may also like", "Other story about buses", "© 2026 Office. All rights reserved."]
    head = f"Village {i} reopens its library"
    middle = "".join(f"<p>{b}</p>" for b in body)
    shell = {
        "div": f'<div class="menu"><p>{menu[0]}</p></div><div class="story"><h1>{head}</h1><p>Published 4 May 2026</p>{middle}</div><div class="rail"><p>{foot[0]}</p><h3>{foot[1]}</h3><li><a href="/o">{foot[2]}</a></li></div><footer><p>{foot[3]}</p></footer>',
        "flat": f'<p>{menu[0]}</p><h1>{head}</h1><p>Published 4 May 2026</p>{middle}<p>{foot[0]}</p><h3>{foot[1]}</h3><li><a href="/o">{foot[2]}</a></li><p>{foot[3]}',
    }[layout]
    blocks = [*menu, head, "Published 4 May 2026", *body, *foot]
    return f"<!doctype html><html><head><title>{head}</title></head><body>{shell}</body></html>", "\n\n".join(blocks), {1, *range(3, 3 + len(body))}


def test_articles_of_clear_and_of_flat_pages(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(60):
        source, text, good = page(i, "flat" if i % 5 == 0 else "div", rng)
        rows.append((i, source, text, "t"))
        want |= {(i, b) for b in good}
    rows += [(100, None, "x", "t"), (101, "", "", "t"), (102, "<p>", "unmatched block", "t")]
    got = {tuple(r) for r in article_blocks(spark.createDataFrame(rows, "page_id BIGINT, html STRING, text STRING, ident STRING")).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_few_pages_and_no_pages(spark):
    source, text, good = page(1, "div", random.Random(1))
    df = spark.createDataFrame([(1, source, text)], "page_id BIGINT, html STRING, text STRING")
    assert {r.block_no for r in article_blocks(df).collect()} == good
    assert article_blocks(df.limit(0)).collect() == []


def test_broken_markup_and_alignment():
    p = Page("<body><div class=a><p>One <b>two</b><p>three<br>four</div></section><li><a href=x>five</a><script>no</script><!-- no --><P>six &amp; seven")
    assert p.texts == ["One two", "three four", "five", "six & seven"] and p.links == [0, 0, 4, 0]
    assert aligned(p, "three four\n\nmissing\n\nsix &  seven") == [1, -1, 3]
    assert Page("").texts == []


def test_decoding_drops_lone_blocks_of_a_foreign_container():
    p = Page("<div><p>a</p><p>b</p></div><nav><p>c</p><p>d</p></nav>")
    assert decode(p, np.array([2.0, 3.0, 0.5, -4.0])).tolist() == [True, True, False, False]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees(trees=20).fit(x[:3000], y[:3000])
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_a_model_is_trained_once(spark, tmp_path, monkeypatch):
    import quern.llm.boilerplate as module

    rows = [(k, f"<body><h1>Head {k}</h1><p>One sentence of text stands here.</p></body>", f"Head {k}\n\nOne sentence of text stands here.") for k in range(8)]
    spark.createDataFrame(rows, "page_id BIGINT, html STRING, text STRING").write.parquet(f"{tmp_path}/pages")
    trained, train = [], module.train
    monkeypatch.setattr(module, "train", lambda sources: trained.append(len(sources)) or train(sources))
    got = [sorted(map(tuple, module.article_blocks(spark.read.parquet(f"{tmp_path}/pages")).collect())) for _ in range(2)]
    assert got[0] == got[1] and trained == [8]
