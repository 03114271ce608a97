"""A process that gets pages: one JSON line in, one JSON line and the body out, until its input ends. It is run by file
name and imports nothing of the package; whoever started it kills it at the deadline of a page."""

from __future__ import annotations

import json
import sys
import urllib.request

MAX_PAGE, REDIRECTS = 8 << 20, 5


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not newurl.lower().startswith(("http://", "https://")):
            raise OSError(f"redirect to {newurl.partition(':')[0]}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def get(url: str, seconds: float) -> bytes:
    """The body behind an address, after at most ``REDIRECTS`` redirects; whatever is not a body is an error."""
    opener = urllib.request.build_opener(_Redirects)
    with opener.open(urllib.request.Request(url, headers={"User-Agent": "factweave"}), timeout=seconds) as r:
        if not 200 <= r.status < 400:
            raise OSError(f"status {r.status}")
        body, said = r.read(MAX_PAGE + 1), r.headers.get("Content-Length")
    if not body:
        raise OSError("empty body")
    if len(body) > MAX_PAGE:
        raise OSError("body too large")
    if said and said.isdigit() and len(body) < int(said):
        raise OSError("body ended early")
    return body


def main() -> None:
    for line in sys.stdin.buffer:
        asked = json.loads(line)
        try:
            body, error = get(asked["url"], asked["seconds"]), None
        except Exception as e:  # any failure of a page is its answer
            body, error = b"", str(e)[:200] or type(e).__name__
        sys.stdout.buffer.write(json.dumps({"bytes": len(body), "error": error}).encode() + b"\n" + body)
        sys.stdout.buffer.flush()


if __name__ == "__main__":
    main()
