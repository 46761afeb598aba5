import sys

from oplake.dump import main

sys.exit(main(sys.argv[1:]))
