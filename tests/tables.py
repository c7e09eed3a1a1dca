"""The small fixed tables with known grades."""

MEDIUM = [
    (1, "alice", "ALICE@GMAIL.COM", None), (2, "Bob", "bob@gmail.com", 30), (3, "charlie", "charlie@gmail.com", 25),
    (4, "Bob", "bob@gmail.com", 30), (5, None, "dave@gmail.com", 40), (6, "eve", "EVE@GMAIL.COM", None),
    (7, "charlie", "charlie@gmail.com", 25), (8, "frank", "frank@gmail.com", 35),
]
HARD = [
    (1, "alice", "Engineering", 75000, None), (2, None, "eng", 999999, 28), (3, "charlie", "HR", 65000, 35),
    (4, "dave", "h.r.", None, 40), (5, "alice", "Engineering", 75000, None), (6, "frank", "ENGINEERING", 80000, 29),
    (7, "grace", "Finance", -5000, 32), (8, "henry", "finance", 70000, None),
]


def medium(spark):
    return spark.createDataFrame([(r[0], *r) for r in MEDIUM], "row_id long, id long, name string, email string, age long")


def hard(spark):
    return spark.createDataFrame([(r[0], *r) for r in HARD], "row_id long, id long, name string, dept string, salary long, age long")
