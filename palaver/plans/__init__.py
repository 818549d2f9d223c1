"""Jobs that chain the operators, and the shared views the registered queries read."""
