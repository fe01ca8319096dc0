"""Connections that are kept between statements."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from ..errors import PoolTimeout, StoreError

#: Connections that a pool holds at most, and seconds to wait for one.
POOL_SIZE, POOL_WAIT_S = 5, 3


def opened(spark: SparkSession, url: str, properties: dict[str, str], driver: str | None = None) -> Any:
    """A connection of the driver's JVM."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if driver:
        jvm.java.lang.Class.forName(driver)
    return jvm.java.sql.DriverManager.getConnection(url, given)


class Pool:
    """At most ``size`` connections, each made when it is first needed and kept for the next who asks.

    Whoever has waited ``wait_s`` seconds gets an error. A connection is handed out without
    an open transaction; one that has died meanwhile is replaced.
    """

    def __init__(self, connect: Callable[[], Any], size: int = POOL_SIZE, wait_s: float = POOL_WAIT_S):
        self._connect, self.size, self.wait_s = connect, size, wait_s
        self._free = threading.Condition()
        self._idle: list[Any] = []
        self._made, self._closed = 0, False

    @property
    def made(self) -> int:
        """Connections that are open."""
        return self._made

    def _taken(self) -> Any:
        """An idle connection, or None where one has to be made; its place is reserved."""
        until = time.monotonic() + self.wait_s
        with self._free:
            while not self._closed:
                if self._idle:
                    return self._idle.pop()
                if self._made < self.size:
                    self._made += 1
                    return None
                if not self._free.wait(max(0.0, until - time.monotonic())) and time.monotonic() >= until:
                    raise PoolTimeout(f"no connection became free in {self.wait_s} s")
            raise StoreError("the pool is closed")

    def _gone(self, connection: Any) -> None:
        """Closes a connection and gives its place free."""
        with contextlib.suppress(Exception):
            if connection is not None:
                connection.close()
        with self._free:
            self._made -= 1
            self._free.notify()

    @contextlib.contextmanager
    def connection(self) -> Iterator[Any]:
        """A connection whose transaction is committed at the end, or rolled back if an error passes."""
        connection = self._taken()
        try:
            if connection is None or not connection.isValid(1):
                if connection is not None:
                    with contextlib.suppress(Exception):
                        connection.close()
                connection = self._connect()
                connection.setAutoCommit(False)
        except BaseException:
            self._gone(None)
            raise
        try:
            yield connection
            connection.commit()
        except BaseException:
            try:
                connection.rollback()
            except Exception:
                self._gone(connection)
            else:
                self._back(connection)
            raise
        self._back(connection)

    def _back(self, connection: Any) -> None:
        with self._free:
            if not self._closed:
                self._idle.append(connection)
                self._free.notify()
                return
        self._gone(connection)

    def close(self) -> None:
        """Closes what is idle; what is in use is closed when it comes back."""
        with self._free:
            self._closed, idle, self._idle = True, self._idle, []
            self._free.notify_all()
        for connection in idle:
            self._gone(connection)
