"""python -m docspark"""

import sys

from docspark.convert import main

if __name__ == "__main__":
    sys.exit(main())
