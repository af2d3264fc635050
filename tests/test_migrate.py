"""Tables from one database to another, with the database that comes with Spark."""

import uuid

import pytest

from abacora.sources import store

TABLES = (
    "CREATE TABLE users (id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, name VARCHAR(40))",
    "CREATE TABLE attempts (id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, user_id BIGINT NOT NULL REFERENCES users(id), score DOUBLE)",
    "CREATE TABLE mistakes (id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, attempt_id BIGINT NOT NULL REFERENCES attempts(id), answer VARCHAR(5))",
)
IDS = {"users": "id", "attempts": "id", "mistakes": "id"}


def database(spark, *more):
    made = store.Jdbc(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    made.execute(*TABLES, *more)
    return made


@pytest.fixture
def source(spark):
    rows = ["INSERT INTO users VALUES (3, 'a'), (7, 'b'), (40, 'c')", "INSERT INTO attempts VALUES (5, 7, 50.5), (6, 3, NULL), (9, 7, 100)"]
    return database(spark, *rows, *(f"INSERT INTO mistakes VALUES ({i}, {[5, 6, 9][i % 3]}, 'B')" for i in range(1, 30)))


def test_migrate_in_the_order_of_foreign_keys(spark, source):
    target = database(spark)
    assert target.in_order(["mistakes", "attempts", "users"]) == ["users", "attempts", "mistakes"]
    done = store.migrate(source, target, ["mistakes", "attempts", "users"], IDS)
    assert done == {"users": 3, "attempts": 3, "mistakes": 29} and list(done) == ["users", "attempts", "mistakes"]
    for t in IDS:
        assert sorted(map(tuple, source(t).collect()), key=str) == sorted(map(tuple, target(t).collect()), key=str)
    target.execute("INSERT INTO users (name) VALUES ('new')", "INSERT INTO attempts (user_id) VALUES (41)")
    assert {r[0] for r in target("users").collect()} == {3, 7, 40, 41} and {r[0] for r in target("attempts").collect()} == {5, 6, 9, 10}


def test_migrate_refuses_what_is_there_before_it_writes(spark, source):
    target = database(spark, "INSERT INTO users VALUES (1, 'x')", "INSERT INTO attempts VALUES (1, 1, 1)", "INSERT INTO mistakes VALUES (1, 1, 'A')", "DELETE FROM mistakes")
    with pytest.raises(ValueError, match="not empty"):
        store.migrate(source, target, list(IDS), IDS)
    assert target("users").count() == 1 and target("mistakes").count() == 0


def test_statements_are_one_transaction(spark, source):
    with pytest.raises(Exception):
        source.execute("INSERT INTO users VALUES (100, 'y')", "INSERT INTO attempts VALUES (100, 999, 1)")
    assert source("users").count() == 3


def test_keys_that_go_round_are_refused(spark):
    made = database(spark, "ALTER TABLE users ADD COLUMN best BIGINT REFERENCES attempts(id)")
    with pytest.raises(ValueError, match="round"):
        made.in_order(["users", "attempts"])


def test_parallel_reads_by_ranges_of_a_key(spark, source):
    ranged = store.Jdbc(spark, source.url, source.properties, "ID", (1, 30, 4))
    assert ranged("mistakes").rdd.getNumPartitions() == 4 and ranged("mistakes").count() == 29
