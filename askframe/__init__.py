"""askframe: knowledge-base building and question answering as Spark jobs."""

from askframe.rules import DEFAULT_PROFILE, Profile

__all__ = ["DEFAULT_PROFILE", "Profile"]
