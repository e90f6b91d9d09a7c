"""One request to a service over HTTP, and what its answer says: that something is there, that nothing is, or nothing at all.

A refusal, a time-out or a body that is no answer must never count as "there is no such record", so each request ends in one
of ``OUTCOMES``. ``Http`` takes its opener from outside; tests give it one that never leaves the process."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Any

OK, ABSENT, TIMEOUT, REFUSED, ERROR = "ok", "not_found", "timeout", "rate_limited", "error"
OUTCOMES = (OK, ABSENT, TIMEOUT, REFUSED, ERROR)
#: What a server says by its status, and how long a client will wait.
SLOW_DOWN, GONE = (429, 503), (404, 410)
LONGEST_WAIT, FIRST_WAIT = 60.0, 2.0


def wait_of(retry_after: str | None, attempt: int, now: float) -> float:
    """Seconds to wait: what the server asks for (a number or a date), else longer with each attempt; never more than a minute."""
    if retry_after:
        try:
            asked = float(retry_after)
        except ValueError:
            try:
                asked = parsedate_to_datetime(retry_after).timestamp() - now
            except (TypeError, ValueError):
                asked = FIRST_WAIT
    else:
        asked = FIRST_WAIT * 2**attempt
    return min(max(asked, 0.0), LONGEST_WAIT)


def unpacked(body: bytes, encoding: str | None) -> bytes:
    """A body as it was before the transfer packed it."""
    if (encoding or "").lower() == "gzip" or body[:2] == b"\x1f\x8b":
        return gzip.decompress(body)
    return zlib.decompress(body) if (encoding or "").lower() == "deflate" else body


@dataclass
class Http:
    """``get`` one address, politely: pace between requests, retries where the server asks to come later."""

    user_agent: str = "citeloom"
    timeout: float = 20.0
    retries: int = 2
    pace: float = 0.0
    opener: Callable[..., Any] = urllib.request.urlopen
    sleep: Callable[[float], None] = time.sleep
    _asked: int = field(default=0, init=False)

    def get(self, url: str, accept: str = "application/json") -> tuple[str, bytes]:
        request = urllib.request.Request(url, headers={"User-Agent": self.user_agent, "Accept": accept, "Accept-Encoding": "gzip"})
        outcome = ERROR
        for attempt in range(self.retries + 1):
            if self._asked and self.pace:
                self.sleep(self.pace)
            self._asked += 1
            try:
                with self.opener(request, timeout=self.timeout) as answer:
                    return OK, unpacked(answer.read(), answer.headers.get("Content-Encoding"))
            except urllib.error.HTTPError as e:
                if e.code in GONE:
                    return ABSENT, b""
                if e.code not in SLOW_DOWN:
                    return ERROR, b""
                outcome = REFUSED
                if attempt < self.retries:
                    self.sleep(wait_of(e.headers.get("Retry-After") if e.headers else None, attempt, time.time()))
            except TimeoutError:
                outcome = TIMEOUT
            except urllib.error.URLError as e:
                outcome = TIMEOUT if isinstance(e.reason, TimeoutError) else ERROR
            except (OSError, EOFError, zlib.error):
                outcome = ERROR
        return outcome, b""

    def json(self, url: str, accept: str = "application/json") -> tuple[str, Any]:
        """A body that isn't JSON is an error, not an empty answer."""
        outcome, body = self.get(url, accept)
        if outcome != OK:
            return outcome, None
        try:
            return OK, json.loads(body)
        except ValueError:
            return ERROR, None
