"""plumbline: review moderation on Spark DataFrames.

Every public operator is a function from DataFrame(s) to DataFrame and can be chained with
``df.transform``.  Expressions that work on one row live in ``functions``, relational operators in
``operators``, readers and writers in ``sources``, end-to-end batch jobs in ``plans`` and the
stream job in ``streaming``.
"""

from plumbline.policy import DEFAULT_POLICY, Policy, load_policy
from plumbline.session import materialize, shared_dir, tuned_session, workspace

__all__ = [
    "DEFAULT_POLICY",
    "Policy",
    "load_policy",
    "materialize",
    "shared_dir",
    "tuned_session",
    "workspace",
]
