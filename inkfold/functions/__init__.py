"""Pure Column expressions; nothing here touches a session or an action."""
