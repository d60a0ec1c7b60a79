"""The whole pipeline against plain Python over a table with planted cases."""

import hashlib
import re

from pyspark.sql import functions as F

from loomwatch.llm import bpe, queries, toxicity
from tests.llm.test_operators import DATA, brute_components, brute_lines_of_any_length, needs_data, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(model, text):
    """Every term is looked for by itself."""
    folded = toxicity.fold(text)
    total = max(0.0, sum(w * len(re.findall(f"(?={re.escape(t)})", folded)) for t, w in model.weights))
    length = len(folded.split())
    return toxicity._chance(model, (toxicity.math.log1p(total), toxicity.math.log1p(100 * total / max(1, length))))


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def plain_windows(items, width=10):
    wins = set()
    for item in items:
        w = plain_words(item)
        wins |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return wins


def has_window(text, wins):
    w = plain_words(text)
    return any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1))


def plain_pipeline(model, docs, items):
    """(doc_id, text) of what the stages keep, and how many each of them took out."""
    taken = []

    def note(before, after):
        taken.append(len(before) - len(after))
        return after

    docs = note(docs, [(i, t) for i, t in docs if plain_score(model, t) < 0.7])
    thinned = brute_lines_of_any_length([t for _, t in docs])
    pairs = [(i, old, new) for (i, old), new in zip(docs, thinned, strict=True)]
    docs = note(docs, [(i, new) for i, old, new in pairs if new == old or new.strip(" ")])
    components, _ = brute_components([t for _, t in docs])
    docs = note(docs, [d for k, d in enumerate(docs, 1) if components[k - 1] == k])
    wins = plain_windows(items)
    return note(docs, [d for d in docs if not has_window(d[1], wins)]), taken


@needs_data
def test_the_pipeline_equals_plain_python(spark, tmp_path):
    import tiktoken

    import corpus_pipeline

    given = queries.table(spark, DATA, "documents")
    labels, benchmark = (queries.table(spark, DATA, n) for n in ("labels", "benchmark"))
    items = [r.text for r in benchmark.collect()]
    held_out = queries.fold_of("doc_id") == 1
    abuse = [r.text for r in given.join(labels.where("toxic = 1").select("doc_id"), "doc_id").where(~held_out).orderBy("doc_id").limit(2).collect()]
    body = [f"word{i}" for i in range(60)]
    near = [*body[:30], "other", *body[31:]]
    item = max(items, key=lambda t: len(plain_words(t)))
    planted = [
        *abuse, " ".join(body), " ".join(body), " ".join(near), words(30, 500) + " " + item + " " + words(30, 600),
        "a line of its own that is long\n" + words(12, 700), words(12, 700) + "\na line of its own that is lone\n" + words(9, 800), None, "", " ",
    ]
    added = spark.createDataFrame([(1_000_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(planted)], COLUMNS)
    given.unionByName(added.select(*[F.col(c).cast(given.schema[c].dataType) for c in given.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = queries.table(spark, str(tmp_path), "documents").select("doc_id", "text")
    model = queries.toxicity_model(spark, docs, str(tmp_path))
    want, taken = plain_pipeline(model, [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], items)
    assert taken[0] and taken[1] and taken[2] and taken[3]

    vocabulary, pattern = queries.tokenizer()
    ranks = {piece: i for i, piece in enumerate(bpe.read_ranks(vocabulary))}
    known = tiktoken.Encoding("known", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    expected = {}
    for i, t in want:
        ids = known.encode_ordinary(t or "")
        expected[i] = (len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expected
