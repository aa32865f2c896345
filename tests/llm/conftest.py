import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """tables(documents=[...], ...): writes rows as Parquet tables and returns their folder."""
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long",
             "labels": "doc_id long, quality int, toxic int",
             "conversations": "conv_id long, turn long, role string, text string",
             "pages": "page_id long, url string, html string",
             "embeddings": "vec_id long, embedding array<float>, label int"}

    def write(**rows):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, data in rows.items():
            spark.createDataFrame(data, kinds[name]).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
