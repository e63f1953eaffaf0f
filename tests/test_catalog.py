from __future__ import annotations

import pytest
from helpers import as_dict, as_set, frame
from pyspark.sql import functions as F

from solvelake.operators import catalog

LINK = "id long, challenge_id long, url string, type string"


@pytest.fixture(scope="module")
def challenges(spark):
    return frame(
        spark,
        [(1, "One", 10, "FLAG", "chall/One"), (2, "two", 20, "FLAG", "chall/two")],
        "id long, name string, points int, flag string, source_folder string",
    )


@pytest.fixture(scope="module")
def links(spark):
    return frame(
        spark, [(1, 1, "b", "web"), (2, 1, "a", "web"), (3, 1, "a", "nc"), (4, 1, "s", "static")], LINK
    )


def test_pivot_and_shapes(challenges, links):
    out = catalog.challenge_catalog(challenges, links)
    assert "flag" not in out.columns
    got = as_dict(out, "id", "links_nc", "links_web", "links_admin", "links_static")
    assert got == {1: (["a"], ["a", "b"], [], ["s"]), 2: ([], [], [], [])}
    nested = catalog.nest_links(out)
    assert nested.schema["links"].dataType.fieldNames() == ["nc", "web", "admin", "static"]
    again = catalog.flatten_links(nested)
    assert as_dict(again, "id", "links_nc", "links_web", "links_admin", "links_static") == got
    assert as_set(catalog.links_of_type(links, "web"), "challenge_id", "url") == {(1, "a"), (1, "b")}
    with pytest.raises(ValueError):
        catalog.links_of_type(links, "ftp")


def test_split_links(spark):
    df = frame(
        spark, [(1, [("web", "x"), ("nc", "y"), ("web", "a")])], "id long, links array<struct<type:string,location:string>>"
    )
    row = df.select(*catalog.split_links(F.col("links"))).first()
    assert (row.links_web, row.links_nc, row.links_admin, row.links_static) == (["x", "a"], ["y"], [], [])


def test_lookups(spark, challenges):
    ids = frame(spark, [(1,), (1,), (9,)], "id long")
    assert sorted((r.id, r.found) for r in catalog.lookup(ids, challenges).collect()) == [(1, True), (1, True), (9, False)]
    names = frame(spark, [("ONE",), ("none",)], "name string")
    assert as_set(catalog.lookup_by_name(names, challenges), "name", "stored_name", "found") == {
        ("ONE", "One", True),
        ("none", None, False),
    }
    assert as_set(catalog.name_available(names, challenges), "name", "available") == {("ONE", False), ("none", True)}
    folders = frame(spark, [("chall/One",), ("chall/one",)], "source_folder string")
    assert as_dict(catalog.folder_to_id(folders, challenges), "source_folder", "challenge_id") == {
        "chall/One": 1,
        "chall/one": None,
    }
    back = frame(spark, [(2,), (3,)], "challenge_id long")
    assert as_dict(catalog.id_to_folder(back, challenges), "challenge_id", "source_folder") == {2: "chall/two", 3: None}
