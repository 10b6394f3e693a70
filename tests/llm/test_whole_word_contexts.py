"""op7's contexts are whole words before a token, not classes of them."""

from ledgerwood.llm import pitman_yor


def test_words_that_end_alike_are_contexts_of_their_own(spark):
    texts = ["scarlet dog", "violet fish"] * 40
    model = pitman_yor.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    asked = ["scarlet dog", "scarlet fish", "violet dog", "violet fish"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    got = {asked[r["doc_id"]]: r["score"] for r in pitman_yor.score(docs, model).collect()}
    # Forty customers of one dish against none: far apart, though both words end in "et".
    assert got["scarlet dog"] > got["scarlet fish"] + 1 and got["violet fish"] > got["violet dog"] + 1
