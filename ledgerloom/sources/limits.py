"""Limits that a deployment may set. Readers take everything unless they are given one."""

#: Usual values by what they bound: links of a page, threads of a listing, topics of a search, characters of a thread, of a
#: section that is read and of a note that is kept, versions of a page.
USUAL = {"links": 10, "threads": 25, "topics": 20, "thread_chars": 4000, "section_chars": 14_000, "note_chars": 2600, "versions": 3}
