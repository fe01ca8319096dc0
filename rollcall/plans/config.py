"""Where the registry's database is, and how to reach it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..sources.pool import POOL_SIZE, POOL_WAIT_S

APPLICATION = "rollcall"


class Secret:
    """A text that doesn't show in logs."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(***)"

    __str__ = __repr__

    def __eq__(self, other) -> bool:
        return isinstance(other, Secret) and other._value == self._value

    def __hash__(self) -> int:
        return hash(self._value)


@dataclass(frozen=True)
class Connection:
    user: str
    password: Secret
    host: str
    database: str
    port: int = 5432
    ssl: bool = False

    def __post_init__(self):
        if not 0 <= int(self.port) <= 65535:
            raise ConfigError(f"not a port: {self.port}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, dotenv: str = ".env", **more) -> Connection:
        """From DB_USERNAME, DB_PASSWORD, DB_HOST and DB_NAME; the first that is missing is an error.

        A file of NAME=value lines adds what the environment lacks; it may be missing.
        """
        env = dict(os.environ if env is None else env)
        if os.path.exists(dotenv):
            with open(dotenv) as lines:
                for line in lines:
                    name, eq, value = line.strip().partition("=")
                    if eq and not name.startswith("#"):
                        env.setdefault(name.strip(), value.strip().strip("'\""))
        values = []
        for name in ("DB_USERNAME", "DB_PASSWORD", "DB_HOST", "DB_NAME"):
            if name not in env:
                raise ConfigError(f"environment variable not found: {name}")
            values.append(env[name])
        return cls(values[0], Secret(values[1]), values[2], values[3], **more)

    @classmethod
    def from_mapping(cls, values: Mapping) -> Connection:
        """From name, pass, database (texts), host (a text or a number), port (a number or its digits) and ssl (a truth value, or true or false as a text)."""
        for name in ("name", "pass", "host", "database", "port", "ssl"):
            if name not in values:
                raise ConfigError(f"connection settings: {name} is missing")

        def text(name: str, *more: type) -> str:
            value = values[name]
            if isinstance(value, bool) or not isinstance(value, (str, *more)):
                raise ConfigError(f"connection settings: {name} isn't a text")
            return str(value)

        port, ssl = values["port"], values["ssl"]
        if isinstance(port, str) and port.strip().isdecimal():
            port = int(port)
        if isinstance(port, bool) or not isinstance(port, int):
            raise ConfigError(f"connection settings: not a port: {port!r}")
        if isinstance(ssl, str) and ssl.strip().lower() in ("true", "false"):
            ssl = ssl.strip().lower() == "true"
        if not isinstance(ssl, bool):
            raise ConfigError(f"connection settings: ssl is neither true nor false: {ssl!r}")
        return cls(text("name"), Secret(text("pass")), text("host", int, float), text("database"), port, ssl)

    def dsn(self) -> Secret:
        """With the database. Nothing is percent-encoded."""
        return Secret(f"{self.server_dsn().reveal()}/{self.database}")

    def server_dsn(self) -> Secret:
        return Secret(f"postgres://{self.user}:{self.password.reveal()}@{self.host}:{self.port}")

    def jdbc(self, database: bool = True) -> dict[str, str]:
        """Options of a JDBC source. The database's name is a name, whatever it reads like."""
        url = f"jdbc:postgresql://{self.host}:{self.port}/" + (quote(self.database, safe="") if database else "")
        return {"url": url, "user": self.user, "password": self.password.reveal(), "sslmode": "require" if self.ssl else "prefer", "ApplicationName": APPLICATION, "numPartitions": str(POOL_SIZE), "connectTimeout": str(POOL_WAIT_S)}

    def with_database(self, name: str) -> Connection:
        return replace(self, database=name)


def masked_dsn(user: Column, host: Column, port: Column, database: Column) -> Column:
    """A DSN for logs."""
    return F.format_string("postgres://%s:***@%s:%d/%s", user, host, port, database)
