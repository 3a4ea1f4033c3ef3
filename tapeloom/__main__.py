from tapeloom.cli import main

raise SystemExit(main())
