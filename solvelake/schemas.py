"""Column lists of the competition tables (Spark DDL).

Ids are strings in general and BIGINT on the derived test tables: ``ddl`` takes the id type.
Timestamps are naive and at second grain. Names marked in ``FOLDED`` compare without regard to case.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "teams": "id {id}, name string, description string, score int, last_solve timestamp_ntz, eligible boolean, "
    "affiliation string, inserted_at timestamp_ntz, updated_at timestamp_ntz",
    "challenges": "id {id}, name string, description string, flag string, points int, authors array<string>, "
    "hints array<string>, categories array<string>, tags array<string>, solve_count int, visible boolean, "
    "source_folder string, inserted_at timestamp_ntz, updated_at timestamp_ntz",
    "challenge_links": "id {id}, challenge_id {id}, url string, type string",
    "users": "id {id}, email string, name string, team_id {id}, score int, last_solve timestamp_ntz, "
    "eligible boolean, admin boolean, inserted_at timestamp_ntz, updated_at timestamp_ntz, "
    "confirmed_at timestamp_ntz",
    "solve_attempts": "id {id}, flag_guess string, correct boolean, user_id {id}, challenge_id {id}, team_id {id}, "
    "inserted_at timestamp_ntz, updated_at timestamp_ntz",
    "solve_successes": "id {id}, attempt_id {id}, user_id {id}, challenge_id {id}, team_id {id}, "
    "solved_at timestamp_ntz",
    "deleted_solves": "id {id}, flag_guess string, correct boolean, user_id {id}, challenge_id {id}, team_id {id}, "
    "inserted_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz",
    "auth_oauth": "id {id}, user_id {id}, provider_name string, sub string, last_used timestamp_ntz, "
    "inserted_at timestamp_ntz, updated_at timestamp_ntz",
    "auth_name_pass": "id {id}, user_id {id}, hashed_password string, last_used timestamp_ntz, "
    "inserted_at timestamp_ntz, updated_at timestamp_ntz",
}

PRIMARY_KEYS = {name: ["id"] for name in TABLES}

# Columns that may be null; every other column is required.
NULLABLE = {
    "teams": {"last_solve", "affiliation"},
    "users": {"team_id", "last_solve", "confirmed_at"},
    "auth_oauth": {"provider_name", "last_used"},
    "auth_name_pass": {"last_used"},
}

# Unique keys beside the primary key.
UNIQUE = {
    "teams": [["name"]],
    "challenges": [["name"], ["source_folder"]],
    "challenge_links": [["challenge_id", "url"]],
    "users": [["email"], ["name"]],
    "solve_successes": [["challenge_id", "team_id"]],
    "auth_oauth": [["user_id", "provider_name"]],
    "auth_name_pass": [["user_id"]],
}

FOLDED = {"teams": {"name"}, "challenges": {"name"}, "users": {"name", "email"}}

# (child, column, parent)
FOREIGN_KEYS = [
    ("challenge_links", "challenge_id", "challenges"),
    ("users", "team_id", "teams"),
    ("solve_attempts", "challenge_id", "challenges"),
    ("solve_attempts", "team_id", "teams"),
    ("solve_attempts", "user_id", "users"),
    ("solve_successes", "attempt_id", "solve_attempts"),
    ("solve_successes", "challenge_id", "challenges"),
    ("solve_successes", "team_id", "teams"),
    ("solve_successes", "user_id", "users"),
    ("auth_name_pass", "user_id", "users"),
    ("auth_oauth", "user_id", "users"),
]

# Columns of at most 255 characters (elements, for arrays).
SHORT_TEXT = {
    "teams": ["affiliation"],
    "challenges": ["flag", "source_folder"],
    "solve_attempts": ["flag_guess"],
    "deleted_solves": ["flag_guess"],
    "auth_oauth": ["sub"],
    "auth_name_pass": ["hashed_password"],
}
SHORT_TEXT_ARRAYS = {"challenges": ["authors", "hints", "tags"]}

# Fixed values of the enumerated columns.
LINK_TYPES = ["nc", "web", "admin", "static"]
SIGNIN_OUTCOMES = ["not_found", "bad_auth", "authenticated"]
DEPLOY_STATUSES = ["started", "building", "pulling", "pushing", "uploading", "success", "failure", "unknown"]
ALERT_LEVELS = ["INFO", "WARN", "ERROR"]
SYNC_TYPES = ["chall", "all_challs", "user", "all_users", "team", "all_teams", "solves", "all"]

ENUMS = {"challenge_links": {"type": LINK_TYPES}}


def ddl(table: str, id_type: str = "string") -> str:
    return TABLES[table].format(id=id_type)


def schema(table: str, id_type: str = "string") -> StructType:
    return StructType.fromDDL(ddl(table, id_type))
