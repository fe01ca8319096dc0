"""The registry's HTTP surface as one function from a request to a response.

Any server can call it; none is needed to use or test it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from urllib.parse import parse_qsl

from pyspark.errors import PySparkException

from ..errors import CodecError, RegistryError, RequestError
from ..functions import codec, generate
from ..functions.ids import parsed_id
from ..schema import PASSWORD_CONFIG

SERVER, CLIENT = "http://127.0.0.1:8000", "http://127.0.0.1:8080"

#: Records of a page that doesn't say how many, and of one at most.
PAGE_ROWS, STREAM_ROWS = 100, 10_000

Response = tuple[int, dict[str, str], str]

PLAIN, JSON = {"content-type": "text/plain; charset=utf-8"}, {"content-type": "application/json"}


class Service:
    """Routes over a store. strict_paths: whether an id in the path has to be that of the body."""

    def __init__(self, store, strict_paths: bool = False):
        self.store, self.strict_paths = store, strict_paths

    def handle(self, method: str, path: str, headers: Mapping[str, str] | None = None, body: str = "") -> Response:
        path, _, query = path.partition("?")
        parts = [x for x in path.split("/") if x]
        asked = dict(parse_qsl(query))
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        routes = {
            ("health",): {"GET": self._health},
            ("book",): {"GET": self._book},
            ("guests",): {"GET": self._all, "POST": self._create},
            ("improv", "name"): {"GET": lambda **_: self._text(lambda: generate.secure_name(False))},
            ("improv", "name", "num"): {"GET": lambda **_: self._text(lambda: generate.secure_name(True))},
            ("improv", "pass"): {"GET": lambda **_: self._text(generate.secure_password), "POST": self._password},
        }
        given = None
        if len(parts) == 2 and parts[0] == "guests":
            given, methods = parts[1], {"GET": self._get, "PUT": self._update, "DELETE": self._delete}
        elif tuple(parts) in routes:
            methods = routes[tuple(parts)]
        else:
            return 404, {}, ""
        if method.upper() not in methods:
            return 405, {"allow": ",".join(methods)}, ""
        if method.upper() in ("POST", "PUT", "DELETE") and not headers.get("content-type", "").split(";")[0].strip().lower().endswith("json"):
            return 415, PLAIN, "Expected a JSON content type"
        try:
            return methods[method.upper()](given=given, body=body, asked=asked)
        except CodecError as e:
            return (400 if str(e).startswith("not JSON") else 422), PLAIN, str(e)
        except (RegistryError, PySparkException) as e:
            return 400, PLAIN, str(e).splitlines()[0]

    def _text(self, make) -> Response:
        return 200, PLAIN, make()

    def _health(self, **_) -> Response:
        return 200, {"access-control-allow-origin": CLIENT}, ""

    def _book(self, **_) -> Response:
        """The version of the store's server; a failure is answered with 200 too, without details."""
        try:
            version = self.store.server_version()
        except (RegistryError, PySparkException):
            version = "unavailable"
        return 200, {"access-control-allow-origin": CLIENT} | PLAIN, version

    def stream_all(self) -> Iterator[str]:
        """The body of GET /guests in pieces, page by page, for a server that needn't hold the whole table; nothing is sorted as a whole."""
        opening, after, more = "[", None, True
        while more:
            rows, after = self.store.page(after, STREAM_ROWS)
            for row in rows:
                yield opening + codec.encode_one(row.asDict(), self.store.table.schema)
                opening = ","
            more = after is not None
        yield "]" if opening == "," else "[]"

    def _all(self, asked: Mapping[str, str], **_) -> Response:
        """All records; with ``limit``, or ``after`` and the cursor of a page before, one page, and in the header x-next the cursor for the next."""
        schema = self.store.table.schema
        if not {"limit", "after"} & set(asked):
            return 200, JSON, codec.encoded_list(self.store.get_all(), schema).first()["body"]
        limit = asked.get("limit", str(PAGE_ROWS))
        if not limit.isdecimal() or not 0 < int(limit) <= STREAM_ROWS:
            raise RequestError(f"not a limit from 1 to {STREAM_ROWS}: {limit!r}")
        rows, after = self.store.page(asked.get("after"), int(limit))
        body = "[" + ",".join(codec.encode_one(r.asDict(), schema) for r in rows) + "]"
        return 200, JSON | ({"x-next": after} if after else {}), body

    def _get(self, given: str, **_) -> Response:
        return 200, JSON, codec.encode_one(self.store.get(parsed_id(given)).asDict())

    def _create(self, body: str, **_) -> Response:
        return 200, JSON, codec.encode_one(self.store.insert(codec.decode_one(body)).asDict())

    def _read(self, given: str, body: str) -> dict:
        record = codec.decode_one(body)
        if self.strict_paths and parsed_id(given) != record["id"]:
            raise RequestError("the id of the path isn't that of the body")
        return record

    def _update(self, given: str, body: str, **_) -> Response:
        return 200, JSON, codec.encode_one(self.store.update(self._read(given, body)))

    def _delete(self, given: str, body: str, **_) -> Response:
        self.store.delete(self._read(given, body))
        return 200, {}, ""

    def _password(self, body: str, **_) -> Response:
        config = generate.PasswordConfig(**codec.decode_one(body, PASSWORD_CONFIG, None))
        return 200, PLAIN, generate.secure_password(config)
