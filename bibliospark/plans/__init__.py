"""Named queries over the driver tables; importing the package registers all of them."""

from bibliospark.plans.registry import ORACLES, QUERIES  # noqa: F401
from bibliospark.plans import filters  # noqa: F401,E402
from bibliospark.plans import joins  # noqa: F401,E402
from bibliospark.plans import aggregate  # noqa: F401,E402
from bibliospark.plans import sources  # noqa: F401,E402
from bibliospark.plans import retrieval  # noqa: F401,E402
from bibliospark.plans import pages  # noqa: F401,E402
from bibliospark.plans import quality  # noqa: F401,E402
from bibliospark.plans import resolve  # noqa: F401,E402
from bibliospark.plans import prep  # noqa: F401,E402
from bibliospark.plans import streams  # noqa: F401,E402
