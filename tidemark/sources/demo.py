"""A small API's traffic in two versions, as exchanges: 19 calls of the first and 11 of the second, whose answers have drifted
(the last login became a number, the avatar went, a role was added, and so was a flag)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .exchanges import with_endpoint

SCHEMA = "ord long, id string, method string, url string, path string, status int, req_body string, body string, content_type string"
_NAMES = ("Ana Reyes", "Bo Lind", "Chidi Okafor", "Dana Petrov", "Emi Sato", "Farid Nasser")
_ROLES = ("admin", "editor", "viewer")


def _user(k: int, version: int) -> dict:
    user = {"id": f"{k:08d}-0000-4000-8000-{k:012d}", "name": _NAMES[k - 1], "email": f"user{k}@example.com", "role": _ROLES[(k - 1) % 3], "createdAt": f"2024-0{k}-05T09:00:00Z"}
    if version == 1:
        user["lastLoginAt"] = None if k % 3 == 0 else f"2024-0{k}-20T12:30:00Z"
        return user | ({"avatarUrl": f"https://example.com/a/{k}.png"} if k % 2 else {})
    return user | {"role": "owner" if k == 1 else user["role"], "lastLoginAt": None if k % 3 == 0 else 1_700_000_000 + k, "mfaEnabled": k % 3 == 1}


def _list(version: int, page: int, limit: int, role: str | None = None) -> dict:
    some = [k for k in range(1, 7) if role is None or _ROLES[(k - 1) % 3] == role]
    return {"page": page, "limit": limit, "total": len(some), "data": [_user(k, version) for k in some[(page - 1) * limit : page * limit]]}


def _calls(version: int) -> list[tuple]:
    """(method, url, status, request body, response body)."""
    pages = [(1, 4, None), (2, 4, None), (1, 3, "admin"), (1, 3, "editor"), (1, 5, "viewer"), (1, 2, None)] if version == 1 else [(1, 4, None), (2, 4, None), (1, 3, "admin"), (1, 5, "viewer")]
    out = [("GET", f"/api/users?page={p}&limit={n}" + (f"&role={r}" if r else ""), 200, None, _list(version, p, n, r)) for p, n, r in pages]
    out += [("GET", f"/api/users/{k}", 200, None, _user(k, version)) for k in range(1, 7)]
    out.append(("GET", "/api/users/999", 404, None, {"error": "User 999 not found", "code": "NOT_FOUND"}))
    if version == 1:
        for k, body in enumerate(({"name": "Gil Moreau", "email": "gil@example.com", "role": "admin"}, {"name": "Hana Novak", "email": "hana@example.com"})):
            out.append(("POST", "/api/users", 201, body, _user(1, 1) | {"id": f"cafe0000-0000-4000-8000-{k:012d}", "name": body["name"], "lastLoginAt": None}))
        out += [("GET", f"/api/posts/{k}", 200, None, {"id": k, "title": f"Post {k}", "tags": ["one", "two"], "stats": {"views": 10 * k, "likes": k}}) for k in (101, 102)]
        out += [("GET", "/api/posts/900", 404, None, {"error": "Post 900 not found", "code": "NOT_FOUND"}), ("GET", "/api/health", 200, None, None)]
    return out


def exchanges(spark: SparkSession, version: int = 1) -> DataFrame:
    text = lambda b: None if b is None else json.dumps(b, separators=(",", ":"))
    rows = [
        (k, f"v{version}-{k}", method, url, url.split("?")[0], status, text(sent), text(got), "text/plain" if got is None else "application/json") for k, (method, url, status, sent, got) in enumerate(_calls(version))
    ]
    return with_endpoint(spark.createDataFrame(rows, SCHEMA))
