import duckdb
import public_tokenizers
import pytest
from texts import body, odd_texts, write_documents
from tokenizers import Tokenizer


@pytest.fixture(scope="session")
def odd():
    return odd_texts()


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory, odd):
    folder = tmp_path_factory.mktemp("odd")
    write_documents(spark, folder, list(odd.items()))
    items = [(0, " ".join(f"Shared{i}" for i in range(5, 17))), (1, "two WORDS!"), (2, None), (3, ""), (4, body(2, 40)), (4, "a b"), (None, "one")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 3 and 1, 0) for i in odd] + [(None, 1, 0), (10_000, 0, 0), (2, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    write_documents(spark, folder, [])
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture
def duck():
    def over(folder, *tables):
        connection = duckdb.connect()
        for name in tables:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        return connection

    return over
