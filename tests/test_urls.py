import pytest
from pyspark.sql import functions as F

from quarrymill.functions import urls

BASES = {"/": "/", "": "/", " docs ": "/docs/", "docs": "/docs/", "/docs": "/docs/", "https://www.x.example/": "/", "https://www.x.example": "/", "https://www.x.example/docs": "/docs/", "https://www.x.example/docs/": "/docs/", "//x.example/a": "/a/",
         "https://x.example/a b": "/a%20b/", "https://x.example/a/../b/./c": "/b/c/", "https://x.example/a/%2E%2e/b": "/b/", "https://x.example/..": "/", "https://x.example/a/.": "/a/", "http://x.example:80/é?q#f": "/%C3%A9/", "https://x.example\\a\\b": "/a/b/",
         "https://u:p@x.example/{a}": "/%7Ba%7D/", "https:///x.example/a": "/a/", "https://": "/https://", "https://x y/a": "/https://x y/a/", "https://x.example:99999/a": "/https://x.example:99999/a/", "https://[::1]/a": "/a/", "a b/../c": "/a b/../c/"}


@pytest.mark.parametrize("base", BASES)
def test_base_url(spark, base):
    assert urls.normalize_base_url(base) == BASES[base]
    assert spark.range(1).select(urls.normalize_base_url_col(F.lit(base))).first()[0] == BASES[base]


@pytest.mark.parametrize(
    ("path", "mode", "url"),
    [
        ("tools/index.html", "pretty", "/docs/tools/"),
        ("index.html", "pretty", "/docs/"),
        ("about.html", "pretty", "/docs/about"),
        ("index.html", "html", "/docs/index.html"),
        ("about.html", "html", "/docs/about.html"),
        ("guide/intro/index.html", "html", "/docs/guide/intro/index.html"),
        ("notes.txt", "pretty", "/docs/"),
        ("xindex.html", "pretty", "/docs/xindex"),
    ],
)
def test_file_url(spark, path, mode, url):
    assert spark.range(1).select(urls.file_url(F.lit(path), "https://x.example/docs", mode)).first()[0] == url


def test_unknown_mode():
    with pytest.raises(ValueError):
        urls.file_url(None, "/", "other")
